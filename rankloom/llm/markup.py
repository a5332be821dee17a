"""Markup residue: which kinds of markup a text carries, and its clean text with headings, lists, tables, code and formulas kept.

Code (fences, spans, <pre>, <code>, verbatim) and formulas are taken out first and put back last, so nothing inside is read
as markup. Texts that start as HTML pages or with a block of one are parted by composite text density: every node has a link-adjusted
number of characters per tag, densities of children are summed, and the subtree with the largest sum is the main content.
Beside it, blocks without headings go that are mostly links and less dense than anything on the path to it; all else is kept,
what follows the page included. Pages and fragments inside other text are kept whole. Kinds are read from what is kept and from what goes.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from rankloom.llm.batches import slices

KINDS = ["markdown", "html", "wiki", "latex"]

# The names of HTML elements.
TAGS = "a abbr address article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup data dd del details dfn dialog div dl dt em embed fieldset figcaption figure font footer form frame h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark menu meta meter nav noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script section select small source span strike strong style sub summary sup table tbody td template textarea tfoot th thead time title tr tt track u ul var video wbr".split()
_NAMES = "|".join(sorted(TAGS, key=len, reverse=True))

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})([^\n]*)$")
_PRE = re.compile(r"<(pre|code|script|style)\b[^<>]*>(.*?)</\1\s*>", re.I | re.S)
_VERBATIM = re.compile(r"\\begin\{(verbatim|lstlisting|minted)\*?\}(.*?)\\end\{\1\*?\}", re.S)
_SPAN = re.compile(r"(?<![`\\])(`{1,2})(?!`)([^\n]*?[^\n`])\1(?!`)")
_QUOTES = re.compile(r"``[^`'\n]+''")
_DISPLAY = re.compile(r"\$\$(.+?)\$\$|\\\[(.+?)\\\]|\\\((.+?)\\\)", re.S)
_EQUATION = re.compile(r"\\begin\{(equation|align|gather|multline|math|displaymath|eqnarray)(\*?)\}(.*?)\\end\{\1\2\}", re.S)
_INLINE = re.compile(r"(?<![\\$\w])\$(?=[^\s$])([^$\n]*?[^\s$\\])\$(?![\d$])")
_MATH = re.compile(r"[\\^_=<>+{}]|^[A-Za-z]$|^[A-Za-z0-9 ,.()'|*/-]{1,12}$")
_MONEY = re.compile(r"^\d[\d.,]*(?:\s|$)")

_TAG = re.compile(rf"</?(?:{_NAMES})(?:\s[^<>]*)?/?>", re.I)
_COMMENT = re.compile(r"<!--.*?-->|<!DOCTYPE[^<>]*>|<!\[CDATA\[.*?\]\]>", re.I | re.S)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")

_WIKI_LINK = re.compile(r"\[\[([^\[\]\n|]+)(?:\|([^\[\]\n]*))?\]\]")
_TEMPLATE = re.compile(r"\{\{([^{}]+)\}\}")
_WIKI_HEAD = re.compile(r"^(={1,6})[ \t]*([^=\s](?:[^\n]*[^=\s])?)[ \t]*\1[ \t]*$", re.M)
_WIKI_BOLD = re.compile(r"(?<!')('{2,5})(?=[^\s'])([^\n]*?[^\s'])\1(?!')")
_WIKI_TABLE = re.compile(r"^\{\|[^\n]*$|^\|\}[ \t]*$|^\|-[^\n|]*$|^\|\+[^\n]*$", re.M)
_WIKI_BLOCK = re.compile(r"^\{\|[^\n]*\n(.*?)^\|\}[ \t]*$", re.M | re.S)
_WIKI_EXTRA = re.compile(r"</?(?:nowiki|ref|references|gallery)\b[^<>]*>|__(?:NO)?TOC__|\[https?://[^\s\[\]]+ [^\[\]\n]+\]", re.I)

_COMMAND = re.compile(r"\\([A-Za-z]+)\*?(?:\[[^\[\]\n]*\])?\{")
_BARE = re.compile(r"\\(?:item|maketitle|tableofcontents|hline|centering|newpage|noindent|par|LaTeX|TeX)(?![A-Za-z])")

_HEAD = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S[^\n]*?)[ \t]*#*[ \t]*$", re.M)
_UNDERLINE = re.compile(r"\n(?:=+|-{2,})[ \t]*$", re.M)
_STRONG = re.compile(r"(?<!\*)\*\*(?=[^\s*])([^\n]*?[^\s*])\*\*(?!\*)|(?<!\w)__(?=[^\s_])([^\n]*?[^\s_])__(?!\w)")
_EMPHASIS = re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]*?[^\s*])\*(?![\w*])|(?<![\w\\])_(?=[^\s_])([^_\n]*?[^\s_])_(?!\w)")
_STRIKE = re.compile(r"~~(?=\S)([^~\n]+?)~~")
_IMAGE = re.compile(r"!\[([^\[\]\n]*)\]\(([^()\n]*)\)")
_LINK = re.compile(r"\[([^\[\]\n]+)\](?:\(([^()\n]*)\)|\[[^\[\]\n]*\])")
_FOOTNOTE = re.compile(r"\[\^[^\[\]\s]+\]:?|^ {0,3}\[[^\[\]\n]+\]:[ \t]+\S+.*$", re.M)
_AUTOLINK = re.compile(r"<((?:https?|ftp|mailto):[^<>\s]+)>")
_BULLET = re.compile(r"^([ \t]*)(?:[-+*]|\d{1,9}[.)])[ \t]+(?=\S)", re.M)
_QUOTE = re.compile(r"^ {0,3}>[ \t]?", re.M)
_ROW = re.compile(r"^[ \t]*\|(?![-+}])[^\n]*\|[ \t]*$|^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$|^[ \t]*\|[ \t]*:?-{2,}:?[ \t]*\|[ \t]*$", re.M)
_DELIMITER = re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t]*$", re.M)
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$", re.M)

_HOLD = re.compile("\ue000(\\d+)\ue001")
#: Stands where a block of a page went, so that marks around it are still read as a pair.
_GONE = "\ue002x\ue002"
#: Stands for & while a page is parsed, so that entities stay as they are written.
_AMP = "\ue003"


class _Node:
    def __init__(self, tag: str, parent: "_Node | None"):
        self.tag, self.parent, self.children, self.parts = tag, parent, [], []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.linked = tag == "a" or parent is not None and parent.linked


class _Tree(HTMLParser):
    VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
    HEAD = {"title", "meta", "link", "script", "style", "base", "noscript", "template"}

    def __init__(self, held: list[str]) -> None:
        super().__init__(convert_charrefs=False)
        self.root = self.at = _Node("root", None)
        self.held, self.gone = held, []

    def handle_starttag(self, tag, attrs):
        if self.at.tag == "head" and tag not in self.HEAD:  # an element of the body closes a head left open
            self.at = self.at.parent
        node = _Node(tag, self.at)
        self.at.children.append(node)
        self.at.parts.append(node)
        node.parts.append(self.get_starttag_text())
        if tag not in self.VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.parts.append(self.get_starttag_text())

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            node.parts.append(f"</{tag}>")
            self.at = node.parent

    def handle_data(self, data):
        self.at.parts.append(data)
        if self.at.tag not in ("script", "style"):
            self.at.chars += len(_ENTITY.sub("x", _HOLD.sub("", data).replace(_AMP, "&")).strip()) + sum(len(self.held[int(m[1])]) for m in _HOLD.finditer(data))

    def handle_comment(self, data):
        self.gone.append(f"<!--{data}-->")

    def handle_decl(self, decl):
        self.gone.append(f"<!{decl}>")

    def handle_pi(self, data):
        self.gone.append(f"<?{data}>")

    def unknown_decl(self, data):
        self.gone.append(f"<![{data}]]>")


_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


def _order(root: _Node) -> list[_Node]:
    """All nodes, parents first; no recursion, whatever the depth."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(node.children)
    return out


#: How pages and fragments of pages begin.
_PAGE = re.compile(r"(?:\s|\ufeff|<\?xml[^<>]*>|<!--.*?-->)*<(?:!doctype\s+html|html|body|div|main|article|section|header|nav|aside)\b", re.I | re.S)
_PAGE_END = re.compile(r"</(html|body)\s*>", re.I)


def _page_end(text: str) -> int:
    """The offset at which the HTML page ends that a text starts with, code set aside."""
    ends = list(_PAGE_END.finditer(text))
    return max((m.end() for m in ends if m[1].lower() == "html"), default=max((m.end() for m in ends), default=len(text)))


def _density(n: _Node, links: float) -> float:
    """Composite text density; links: the share of the body's characters that are in links. Text of links has none."""
    if not n.chars or n.linked:
        return 0.0
    base = math.log(n.chars / max(n.chars - n.link_chars, 1) * n.link_chars + links * n.chars + math.e)
    return n.chars / max(n.tags, 1) * math.log(n.chars / max(n.link_chars, 1) * max(n.tags, 1) / max(n.link_tags, 1), base)


def _written(node: _Node) -> str:
    out, todo = [], [node]
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            out.append(part)
        else:
            todo.extend(reversed(part.parts))
    return "".join(out)


def main_content(page: str, held: list[str]) -> tuple[str, list[str]]:
    """A whole HTML page without head, scripts and blocks of links beside its main content, as HTML, and all that went.

    held: what the marks in the page stand for, which counts as its text.
    """
    tree = _Tree(held)
    tree.feed(page.replace("&", _AMP))
    tree.close()
    nodes = _order(tree.root)
    for n in reversed(nodes):
        for c in n.children:
            n.chars += c.chars
            n.tags += c.tags + 1
            n.link_chars += c.chars if c.tag == "a" else c.link_chars
            n.link_tags += 1 if c.tag == "a" else c.link_tags
    body = next((n for n in nodes if n.tag == "body"), tree.root)
    links = max(body.link_chars, 1) / max(body.chars, 1)
    inside = _order(body)
    dense = {id(n): _density(n, links) for n in inside}
    sums = {id(n): sum(dense[id(k)] for k in n.children) for n in inside}
    best = max(inside, key=lambda n: sums[id(n)])
    floor, node = dense[id(best)], best
    while node is not body and node.parent is not None:  # the lowest density on the path from the body
        node = node.parent
        floor = min(floor, dense.get(id(node), floor))
    kept, node = {id(n) for n in _order(best)}, best
    while node is not None:
        kept.add(id(node))
        node = node.parent
    heads: set[int] = set()
    for n in reversed(nodes):
        if n.tag in _HEADINGS or any(id(k) in heads for k in n.children):
            heads.add(id(n))
    out, todo = [], [tree.root]
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            out.append(part)
        elif part.tag not in ("script", "style", "nav", "head") and (id(part) in kept or id(part) in heads or part.link_tags < 2 or part.link_chars * 2 <= part.chars or _density(part, links) >= floor):
            todo.extend(reversed(part.parts))
        else:
            out.append(_GONE if part.chars else "")
            tree.gone.append(_written(part))
    return "".join(out).replace(_AMP, "&"), [part.replace(_AMP, "&") for part in tree.gone]


_BRACE = re.compile(r"[{}]")


def _braces(text: str) -> dict[int, int]:
    """The offset of the closing brace of every opening one that has one."""
    opened, closed = [], {}
    for m in _BRACE.finditer(text):
        if m[0] == "{":
            opened.append(m.start())
        elif opened:
            closed[opened.pop()] = m.start()
    return closed


_LEVEL = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5, "title": 1}
_DROPPED = {"cite", "ref", "label", "eqref", "pageref", "citep", "citet", "usepackage", "documentclass", "vspace", "hspace", "bibliography", "bibliographystyle", "includegraphics", "begin", "end", "input", "include"}


def _latex(text: str) -> str:
    out, at, closed = [], 0, _braces(text)
    while m := _COMMAND.search(text, at):
        end = closed.get(m.end() - 1, -1)
        if end < 0:
            out.append(text[at : m.end()])
            at = m.end()
            continue
        name, inner = m[1], text[m.end() : end]
        before = text[at : m.start()]
        out.append(before[:-1] if name in _DROPPED and before.endswith("~") else before)
        if name in _LEVEL:
            out.append(f"\n{'#' * _LEVEL[name]} {_latex(inner)}\n")
        elif name == "href" and text[end + 1 : end + 2] == "{" and (stop := closed.get(end + 1, -1)) > 0:
            out.append(_latex(text[end + 2 : stop]))
            end = stop
        elif name not in _DROPPED:
            out.append(_latex(inner))
        at = end + 1
    out.append(text[at:])
    return re.sub(r"\\item(?![A-Za-z])[ \t]*(?:\[([^\]\n]*)\])?", lambda m: "- " + (m[1] + " " if m[1] else ""), "".join(out)).replace("\\\\\n", "\n")


def _template(m: re.Match) -> str:
    fields = [f.strip() for f in m[1].split("|")]
    return "\n".join(f.replace("=", ": ", 1) for f in fields[1:] if f) or ""


def _wiki_table(m: re.Match) -> str:
    rows, cells = [], []
    for line in [*m[1].split("\n"), "|-"]:
        line = line.strip()
        if line.startswith(("|-", "|}")):
            rows += [" | ".join(cells)] if cells else []
            cells = []
        elif line[:1] in "|!" and line:
            cells += [c.strip() for c in re.split(r"\|\||!!", line[1:])]
    return "\n".join(rows)


def _html(text: str) -> str:
    text = _COMMENT.sub("", text)
    text = re.sub(r"<h([1-6])\b[^<>]*>", lambda m: "\n" + "#" * int(m[1]) + " ", text, flags=re.I)
    text = re.sub(r"<li\b[^<>]*>\s*", "\n- ", text, flags=re.I)
    text = re.sub(r"</t[dh]>\s*<t[dh]\b[^<>]*>", " | ", text, flags=re.I)
    text = re.sub(r"</?(?:p|div|br|tr|table|ul|ol|h[1-6]|blockquote|section|article|hr|dl|dt|dd)\b[^<>]*/?>", "\n", text, flags=re.I)
    return _TAG.sub("", text)


def _underlined(text: str) -> list[tuple[int, int, int, str]]:
    """(start and end of the title line, end of the line under it, mark) of titles underlined with = or -."""
    out = []
    for m in _UNDERLINE.finditer(text):
        start = text.rfind("\n", 0, m.start()) + 1
        title = text[start : m.start()].strip()
        if title and title[0] not in "|>-=#" and re.search(r"\w", title):
            out.append((start, m.start(), m.end(), m[0][1]))
    return out


def convert(text: str | None) -> tuple[str | None, list[str]]:
    """The clean text and the kinds of markup found, in the order of KINDS. Null gives null, no kinds."""
    if text is None:
        return None, []
    return _read(text, True)


def _read(text: str, reduce: bool, held: list[str] | None = None) -> tuple[str, list[str]]:
    """The clean text and the kinds; with ``reduce`` a page that the text starts with gives its main content only, and kinds of all of it.

    held: what the marks in a part of a text stand for.
    """
    t = text
    if held is None:
        t, held = re.sub("[\ue000-\ue003]", "", text.replace("\r\n", "\n")), []
    found: set[str] = set()

    def hold(kept: str, kind: str | None = None) -> str:
        if kind:
            found.add(kind)
        held.append(kept)
        return f"\ue000{len(held) - 1}\ue001"

    if "```" in t or "~~~" in t:
        lines, fence, block = [], "", []
        for line in t.split("\n"):
            m = _FENCE.match(line)
            if fence:
                if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                    lines.append(hold("```\n" + "\n".join([*block, "```"])))
                    fence = ""
                else:
                    block.append(line)
            elif m and not (m[1][0] == "`" and "`" in m[2]):
                fence, block = m[1], []
                found.add("markdown")
            else:
                lines.append(line)
        if fence:
            lines.append(hold("```\n" + "\n".join([*block, "```"])))
        t = "\n".join(lines)
    angle, slash, brace = "<" in t, "\\" in t, "{" in t
    page = reduce and angle and _PAGE.match(t)
    if angle:

        def block(m: re.Match) -> str:
            found.add("html")
            if m[1].lower() in ("script", "style"):
                return ""
            inner = html.unescape(_TAG.sub("", m[2]))
            return hold("\n```\n" + inner.strip("\n") + "\n```\n" if m[1].lower() == "pre" else inner)

        t = _PRE.sub(block, t)
    if slash:
        t = _VERBATIM.sub(lambda m: hold("\n```\n" + m[2].strip("\n") + "\n```\n", "latex"), t)
    if "``" in t:
        t = _QUOTES.sub(lambda m: (found.add("latex"), '"' + m[0][2:-2] + '"')[1], t)
    if "`" in t:
        t = _SPAN.sub(lambda m: hold(m[2].strip(), "markdown"), t)
    if slash:
        t = _EQUATION.sub(lambda m: hold("$$" + m[3].strip() + "$$", "latex"), t)
    if slash or "$$" in t:
        t = _DISPLAY.sub(lambda m: hold((f"$${m[1].strip()}$$" if m[1] else f"$${m[2].strip()}$$" if m[2] else f"${m[3].strip()}$"), "latex"), t)
    if t.count("$") > 1:
        t = _INLINE.sub(lambda m: hold(m[0], "latex") if _MATH.search(m[1]) and not _MONEY.match(m[1]) else m[0], t)
    if page:
        end = _page_end(t)
        kept, gone = main_content(t[:end], held)
        t = kept + t[end:]
        for part in gone:
            found.update(_read(part, False, held)[1])
    if slash and (_COMMAND.search(t) or _BARE.search(t)):
        found.add("latex")
        t = _latex(t.replace("\\%", "%").replace("\\&", "&").replace("\\_", "_").replace("\\#", "#"))
        t = _BARE.sub("", t)
        latex_heads = True
    else:
        latex_heads = False
    if brace:
        if _TEMPLATE.search(t):
            found.add("wiki")
            t = _TEMPLATE.sub(_template, t)
        t = _WIKI_BLOCK.sub(lambda m: (found.add("wiki"), _wiki_table(m))[1], t) if "{|" in t else t
    if "|" in t and _WIKI_TABLE.search(t):
        found.add("wiki")
        t = re.sub(r"^[|!][ \t]+", "", _WIKI_TABLE.sub("", t), flags=re.M) if not _ROW.search(t) else _WIKI_TABLE.sub("", t)
    if "[[" in t and _WIKI_LINK.search(t):
        found.add("wiki")
        t = _WIKI_LINK.sub(lambda m: "" if m[1].lower().startswith(("file:", "image:", "category:")) else m[2] or m[1], t)
    if "''" in t and _WIKI_BOLD.search(t):
        found.add("wiki")
        t = _WIKI_BOLD.sub(lambda m: m[2], t)
    if "==" in t or t[:1] == "=" or "\n=" in t:
        if _WIKI_HEAD.search(t):
            found.add("wiki")
            t = _WIKI_HEAD.sub(lambda m: hold(f"{'#' * len(m[1])} {m[2]}"), t)
    if _WIKI_EXTRA.search(t):
        found.add("wiki")
        t = _WIKI_EXTRA.sub("", t)
    if not latex_heads and "#" in t or latex_heads and _HEAD.search(text):
        if _HEAD.search(t):
            found.add("markdown")
    if angle:
        if _TAG.search(t) or _COMMENT.search(t):
            found.add("html")
        if _AUTOLINK.search(t):
            found.add("markdown")
            t = _AUTOLINK.sub(lambda m: m[1], t)
    marks = t
    if latex_heads:
        marks = re.sub(r"^- ", "", t, flags=re.M) if "\\item" in text else t
    if angle:
        t = _html(t)
    if "&" in t and any(html.unescape(m[0]) != m[0] for m in _ENTITY.finditer(t)):
        found.add("html")
        t = html.unescape(t)
    if _BULLET.search(marks) or _QUOTE.search(marks) or _RULE.search(marks) or "|" in marks and _ROW.search(marks) or ("\n--" in marks or "\n=" in marks) and _underlined(marks):
        found.add("markdown")
    for mark, pattern in (("![", _IMAGE), ("](", _LINK), ("][", _LINK), ("]", _FOOTNOTE), ("*", _STRONG), ("__", _STRONG), ("*", _EMPHASIS), ("_", _EMPHASIS), ("~~", _STRIKE)):
        if mark in t and pattern.search(t):
            found.add("markdown")
            t = pattern.sub(lambda m: next((g for g in m.groups() if g), ""), t) if pattern is not _FOOTNOTE else pattern.sub("", t)
    if "\n--" in t or "\n=" in t:
        for a, b, end, mark in reversed(_underlined(t)):
            t = t[:a] + ("# " if mark == "=" else "## ") + t[a:b].strip() + t[end:]
    t = _DELIMITER.sub("", t) if "-" in t else t
    t = _RULE.sub("", t)
    t = _QUOTE.sub("", t)
    t = _BULLET.sub(lambda m: m[1] + "- ", t)
    t = _HEAD.sub(lambda m: f"{m[1]} {m[2]}", t)
    if "|" in t:
        t = re.sub(r"^[ \t]*\|[ \t]*(.*?)[ \t]*\|[ \t]*$", lambda m: re.sub(r"[ \t]*\|[ \t]*", " | ", m[1]), t, flags=re.M)
    t = t.replace(_GONE, "") if page else t
    t = t.replace("\xa0", " ")
    t = re.sub(r"[ \t]+$", "", t, flags=re.M)
    t = re.sub(r"(?<=\S)[ \t]{2,}", " ", t)
    while "\ue000" in t:
        t = _HOLD.sub(lambda m: held[int(m[1])], t)
    t = t.replace(_GONE, "") if page else t  # in what was set aside
    return re.sub(r"\n{3,}", "\n\n", t).strip(), [k for k in KINDS if k in found]


SCHEMA = "ref_id string, version string, clean_text string, kinds array<string>"


def _convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in slices(batches):
        done = [convert(t) for t in pdf["text"]]
        yield pd.DataFrame({"ref_id": pdf["ref_id"], "version": pdf["version"], "clean_text": [c for c, _ in done], "kinds": [k for _, k in done]})


def _kinds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in slices(batches):
        yield pd.DataFrame({"ref_id": pdf["ref_id"], "version": pdf["version"], "kinds": [convert(t)[1] for t in pdf["text"]]})


def clean(texts: DataFrame) -> DataFrame:
    """ref_id, version, clean_text and kinds of every row of (ref_id, version, text); other columns are ignored.

    Null gives null without kinds, blank texts an empty text; a row's result depends on its text alone, repeated rows repeat.
    """
    return texts.select("ref_id", "version", "text").mapInPandas(_convert, SCHEMA)


def kinds(texts: DataFrame) -> DataFrame:
    """As clean, without the text: what moves on is a few words a row."""
    return texts.select("ref_id", "version", "text").mapInPandas(_kinds, "ref_id string, version string, kinds array<string>")
