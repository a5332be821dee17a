import re

import pytest

from rankloom.llm import markup as M


@pytest.mark.parametrize(
    "text",
    [None, "", "  \u00a0", "Seats cost $40 and later $60 each.", "Files lie in C:\\data\\new_table for now.", "The ratio stayed < 5 % and margins > 12 %.", "See field claim_state_code.", "R&D and Q&A share {one} budget.", "Rates a_b_c differ; k<4 holds and m>9 too.", "note [3] and ticket #12.",
     "The check is 2 * 3 * 4 hours.", "It's the brokers' idea, not the team's.", "from 10^3 to 10^4 ~ tenfold", "a == b", "#12 x", "US$5–$10 and $3,000"],
)
def test_no_markup(text):
    assert M.convert(text)[1] == []


@pytest.mark.parametrize(
    "text, kinds",
    [("# Title\ntext", ["markdown"]), ("a **b** c", ["markdown"]), ("a `<b>` c", ["markdown"]), ("```\n<b> $x$ [[y]] \\frac{a}{b}\n```", ["markdown"]), ("| a | 5 |\n|---|:-:|\n| b | 6 |", ["markdown"]), ("> quoted", ["markdown"]), ("- item", ["markdown"]), ("a [b](/c) d", ["markdown"]), ("a\n===\nb", ["markdown"]),
     ("x &nbsp;&mdash; y", ["html"]), ("<p class='x'>a</p>", ["html"]), ("a<br/>b", ["html"]), ("<!-- c -->a", ["html"]), ("<pre><code>**a** [[b]]</code></pre>", ["html"]), ("a [[b|c]] d", ["wiki"]), ("{{Infobox|name=x}}", ["wiki"]), ("== Head ==\na", ["wiki"]), ("a '''b''' c", ["wiki"]),
     ("{| class=x\n|-\n| a\n|}", ["wiki"]), ("a $x_1$ b", ["latex"]), ("\\section{A}", ["latex"]), ("see~\\cite{a}", ["latex"]), ("\\begin{itemize}\n\\item a\n\\end{itemize}", ["latex"]), ("$$E = mc^2$$", ["latex"]), ("\\(x\\)", ["latex"]), ("# A\n<b>x</b> $y^2$ [[z]]", ["markdown", "html", "wiki", "latex"])],
)
def test_kinds(text, kinds):
    assert M.convert(text)[1] == kinds
    assert M.convert(text.replace("\n", "\r\n"))[1] == kinds


def test_structure_is_kept():
    md = "# Head\n\nA **bold** [link](/x) and `code_x`.\n\n- one\n- two\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```py\nx = [[1]]\n```\n\n$a_1^2$ stays"
    clean, _ = M.convert(md)
    assert clean == "# Head\n\nA bold link and code_x.\n\n- one\n- two\n\na | b\n\n1 | 2\n\n```\nx = [[1]]\n```\n\n$a_1^2$ stays"
    assert M.convert("<h2>H</h2><ul><li>a<li>b</ul><table><tr><th>x</th><th>y</th></tr></table>&lt;z&gt;")[0] == "## H\n\n- a\n- b\n\nx | y\n\n<z>"
    assert M.convert("\\section{A}\ntext~\\cite{b} \\textbf{c}\n\\begin{itemize}\n\\item d\n\\end{itemize}")[0] == "## A\n\ntext c\n\n- d"
    assert M.convert("== A ==\n[[b|c]] ''d'' [[File:x.png]]\n{|\n|-\n! h\n|-\n| v\n|}")[0] == "## A\nc d\nh\nv"


def test_main_content_of_a_page():
    body = "".join(f"<p>Paragraph {i} with a good number of words in it and no links at all.</p>" for i in range(6))
    nav = "<ul>" + "".join(f"<li><a href='/{i}'>Go {i}</a></li>" for i in range(8)) + "</ul>"
    page = f"<html><head><title>t</title></head><body><div>{nav}</div><div id='m'>{body}</div></body></html>"
    clean, kinds = M.convert(page)
    assert kinds == ["html"] and "Paragraph 5" in clean and "Go 3" not in clean


def test_pages_inside_other_text_and_text_beside_pages():
    doc = "# Guide\n\nPut it into `<body>` first.\n\n- one\n\n== Wiki ==\n[[b|c]] and \\textbf{d}"
    clean, kinds = M.convert(doc)
    assert kinds == ["markdown", "wiki", "latex"] and clean.startswith("# Guide\n\nPut it into <body> first.") and clean.endswith("c and d")
    page = "<html><head><title>t</title></head><body><p>Inside the page.</p></body></html>"
    clean, kinds = M.convert(f"# Before\n\n{page}\n\n**After** [[x|y]]")
    assert kinds == ["markdown", "html", "wiki"] and clean.startswith("# Before") and "Inside the page." in clean and clean.endswith("After y")
    clean, kinds = M.convert(f"{page}\n\n## After\n\n[[x|y]] `</html>` end")
    assert kinds == ["markdown", "html", "wiki"] and clean == "Inside the page.\n\n## After\n\ny </html> end"
    assert M.convert(page + page.replace("Inside", "Beyond"))[0] == "Inside the page.\n\nBeyond the page."


def test_content_beside_the_densest_block_is_kept():
    dense = "".join(f"<p>Paragraph {i} with a good number of words in it and no links at all.</p>" for i in range(6))
    nav = "<ul>" + "".join(f"<li><a href='/{i}'>Go {i}</a></li>" for i in range(8)) + "</ul>"
    page = f"<!DOCTYPE html><html><head><title>t</title><body><h1>Title</h1><div>{nav}</div><div><p>Lead of the page.</p></div><div>{dense}</div><div><h2>More</h2><table><tr><td>a</td><td>b</td></tr></table></div>$x_1$</body></html>"
    clean, kinds = M.convert(page)
    assert kinds == ["html", "latex"] and "Go 3" not in clean
    assert all(part in clean for part in ("# Title", "Lead of the page.", "Paragraph 5", "## More", "a | b", "$x_1$"))


def test_deep_and_long_texts():
    assert M.convert("<div>" * 5000 + "x" + "</div>" * 5000)[1] == ["html"]
    assert M.convert("<html><body>" + "<div>" * 3000 + "x")[0] == "x"
    assert M.convert("a\n" * 200_000)[1] == []
    assert M.convert("*" * 20_000)[1] in ([], ["markdown"])


def test_table(spark):
    rows = [("a", "1", "# x", 9), ("a", "2", "<b>y</b>", 9), ("b", None, None, None), (None, "1", "", 1)]
    df = spark.createDataFrame(rows, "ref_id string, version string, text string, kinds int")
    assert sorted((r.ref_id or "", r.clean_text, tuple(r.kinds)) for r in M.clean(df).collect() if r.clean_text is not None) == [("", "", ()), ("a", "# x", ("markdown",)), ("a", "y", ("html",))]
    assert M.kinds(df).count() == 4 and M.clean(df.limit(0)).collect() == []


def test_fragments_lose_their_menus_and_keep_all_else():
    menu = '<div class="menu"><ul>' + "".join(f'<li><a href="/{i}">Page number {i}</a></li>' for i in range(60)) + "</ul></div>"
    body = "<div><h2>Claims</h2><p>" + "A claim is filed within thirty days of the event. " * 6 + '</p><p>See <a href="/x">the form</a>.</p></div>'
    clean, kinds = M.convert(f"<div>{menu}{body}</div>\n\nAfter the fragment.")
    assert kinds == ["html"] and "Page number 7" not in clean and clean.startswith("## Claims") and "the form" in clean and "After the fragment." in clean


def test_long_formulas_links_and_arguments():
    long = "a" * 6000
    clean, kinds = M.convert(f"\\textbf{{{long} \\emph{{b}}}} and {{{{box|{long}}}}} and [[{long}|shown]] and $x_1 + {'y + ' * 400} z$")
    assert kinds == ["wiki", "latex"] and clean.startswith(long + " b and") and "shown" in clean and "{{" not in clean and clean.endswith("z$")


def test_density_is_the_composite_one():
    import math

    node = M._Node("div", None)
    node.chars, node.tags, node.link_chars, node.link_tags = 300, 6, 60, 2
    want = 300 / 6 * math.log(300 / 60 * 6 / 2) / math.log(math.log(300 / 240 * 60 + 0.25 * 300 + math.e))
    assert M._density(node, 0.25) == pytest.approx(want)
    assert M._density(M._Node("b", M._Node("a", node)), 0.25) == 0


def test_bare_links_are_no_main_content():
    links = "".join(f'<a href="/{i}">Page number {i} of the handbook</a> ' for i in range(80))
    body = "".join(f"<p>Paragraph {i} with a good number of words in it and no links at all.</p>" for i in range(6))
    clean, kinds = M.convert(f"<html><body><div>{links}</div><div>{body}</div></body></html>")
    assert kinds == ["html"] and "Page number 7 " not in clean and "Paragraph 0" in clean and "Paragraph 5" in clean


MENU = "<ul>" + "".join(f"<li><a href='/{i}'>Go {i}</a></li>" for i in range(30)) + "<li><a href='/x'>{}</a></li></ul>"
MAIN = "".join(f"<p>Paragraph {i} with a good number of words in it and no links at all.</p>" for i in range(6))


@pytest.mark.parametrize("marks", ["[[a|b]]", "**b**", "$x_1$", "&copy x", "\\textbf{c}", "{{t|n=v}}", "<!-- [[q]] -->", "`<nav> [[b]]`", "<code>$x$ [[b]]</code>", "words", "{} {}"])
@pytest.mark.parametrize("page", ["<div>{menu}</div><div>{main}</div>", "<!DOCTYPE html><head><title>{marks}</title></head><body><nav>{marks}</nav>{main}", "<body>{main}{marks}</body>\n\n[a](/b)", "<div>**<nav>menu {marks} here</nav>** and {main}</div>", "<div>**<nav><!-- c --></nav>** and {main}</div>"])
def test_kinds_of_a_page_are_those_of_what_is_kept_and_what_goes(page, marks, monkeypatch):
    import pandas as pd

    parted = []
    split = M.main_content
    monkeypatch.setattr(M, "main_content", lambda *args: parted.append(split(*args)) or parted[-1])
    text = page.replace("{menu}", MENU.replace("{}", marks, 1)).replace("{main}", MAIN).replace("{marks}", marks)
    found = pd.concat(M._kinds(iter([pd.DataFrame({"ref_id": ["a"], "version": ["1"], "text": [text]})])))
    assert len(parted) == 1 and found["kinds"][0] == M._read(text, False)[1]
    clean = M.convert(text)[0]
    assert "Paragraph 5" in clean and "Go 7" not in clean and not re.search("[\ue000-\ue003]", clean)
