"""Text functions as column expressions; lengths and offsets are code points, white space is that of Unicode.

All of them give null for null unless stated otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters taken as white space, as a class body for regular expressions.
WS = r"\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"

# Stop words.
STOPWORDS = (
    "a about all am an and any are as at be been being but by can could did do does doing during each for from had has have having he her here his how i if in into is it its "
    "me more most my no not of on or other our should so some than that the their them then there these they this those through to was we were what when where which who whom why will with would you your"
).split()

# Abbreviations whose full stop ends no sentence, in any case.
ABBREVIATIONS = ["Co", "Corp", "Dr", r"e\.g", "etc", "Fig", r"i\.e", "Inc", "Jr", "Ltd", "Mr", "Mrs", "Ms", "No", "Prof", "Sr", "St", r"U\.S", "vs"]


def trim_all(c: Column) -> Column:
    """The text without white space of any kind at both ends."""
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+\\z", "")


def estimate_tokens(c: Column) -> Column:
    """A token for every four characters begun; 0 for the empty text."""
    return F.ceil(F.length(c) / 4).cast("int")


def tokenize(c: Column) -> Column:
    """Words in lower case: letters, digits, hyphens and apostrophes between white space; all else separates."""
    spaced = F.regexp_replace(F.lower(c), f"[^\\p{{L}}\\p{{N}}'{WS}-]", " ")
    return F.filter(F.split(spaced, f"[{WS}]+"), lambda w: w != "")


def content_tokens(c: Column) -> Column:
    """Words of two characters or more that are no stop words."""
    return F.filter(tokenize(c), lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS))


def without_possessive(w: Column) -> Column:
    return F.when(F.endswith(w, F.lit("'s")), F.left(w, F.length(w) - 2)).otherwise(w)


def without_suffix(b: Column) -> Column:
    """The first of -ies (to -y), -es, -s, -ing, -ed that the length allows is cut off."""
    n = F.length(b)
    cut = lambda k: F.left(b, n - k)
    ends = lambda s: F.endswith(b, F.lit(s))
    return (
        F.when((n > 4) & ends("ies"), F.concat(cut(3), F.lit("y")))
        .when((n > 4) & ends("es") & ~ends("ses"), cut(2))
        .when((n > 3) & ends("s") & ~ends("ss"), cut(1))
        .when((n > 5) & ends("ing"), cut(3))
        .when((n > 4) & ends("ed"), cut(2))
        .otherwise(b)
    )


def stem(w: Column) -> Column:
    """A light stem: the possessive goes, then one suffix."""
    return without_suffix(without_possessive(w))


def stem_all(words: Column) -> Column:
    """The stems of an array of words; two passes, since a lambda evaluates each mention of an expression anew."""
    return F.transform(F.transform(words, without_possessive), without_suffix)


def stems(c: Column) -> Column:
    """The stems of the content words, in order."""
    return stem_all(content_tokens(c))


def normalize_for_match(c: Column) -> Column:
    """The form in which phrases are looked for: lower case, straight quotes, few kinds of punctuation, single blanks."""
    t = F.regexp_replace(F.lower(c), "[‘’]", "'")
    t = F.regexp_replace(t, f"[^\\p{{L}}\\p{{N}}'%$.{WS}-]", " ")
    return trim_all(F.regexp_replace(t, f"[{WS}]+", " "))


def quoted(c: Column) -> Column:
    """A text as a literal for regular expressions."""
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def at_word_boundary(text: Column, phrase: Column) -> Column:
    """Whether the phrase occurs with no letter or digit next to it."""
    return F.regexp_like(text, F.concat(F.lit("(?<![\\p{L}\\p{N}])"), quoted(phrase), F.lit("(?![\\p{L}\\p{N}])")))


def stem_span(keyword_words: Column, text_words: Column) -> Column:
    """Distance between the outermost of the first places at which the words occur by stem; null if one doesn't."""
    stemmed = stem_all(text_words)
    places = F.transform(keyword_words, lambda w: F.array_position(stemmed, stem(w)))
    return F.when(F.exists(places, lambda p: p == 0), F.lit(None)).otherwise(F.array_max(places) - F.array_min(places))


def keyword_present(keyword: Column, text: Column) -> Column:
    """Whether a keyword occurs: as a phrase at word boundaries, else its words by stem within four places a word."""
    return keyword_in_normal(normalize_for_match(keyword), normalize_for_match(text))


def keyword_in_normal(k: Column, h: Column) -> Column:
    """As keyword_present, for texts that are normalised already."""
    words, there = F.split(k, " "), F.split(h, " ")
    span = stem_span(words, there)
    near = F.when(F.size(words) > 1, F.coalesce(span <= F.size(words) * 4, F.lit(False))).otherwise(F.array_contains(stem_all(there), stem(k)))
    return F.when((k == "") | (h == ""), F.lit(False)).when(at_word_boundary(h, k), F.lit(True)).otherwise(near)


def clean_extracted(c: Column) -> Column:
    """Text without the white-space noise of extraction."""
    t = F.regexp_replace(c, "\\r\\n?", "\n")
    t = F.replace(t, F.lit(" "), F.lit(" "))
    t = F.regexp_replace(t, "[\\x{200b}-\\x{200d}\\x{feff}]", "")
    t = F.regexp_replace(t, "[ \\t]+\\n", "\n")
    t = F.regexp_replace(t, "\\n{3,}", "\n\n")
    return trim_all(F.regexp_replace(t, "[ \\t]{2,}", " "))


def _last(text: Column, what: str) -> Column:
    """The 0-based offset of the last occurrence, -1 if there is none."""
    at = F.locate(what[::-1], F.reverse(text))
    return F.when(at == 0, F.lit(-1)).otherwise(F.length(text) - at + 1 - len(what))


def embed_input(c: Column) -> Column:
    """PRJ-8: what is sent to be embedded: a single blank for a null or blank text."""
    return F.when(F.coalesce(trim_all(c), F.lit("")) == "", F.lit(" ")).otherwise(c)


def trim_to_chars(c: Column, budget: int) -> Column:
    """The text cut to a budget at its last paragraph, sentence or line end if that keeps more than four fifths, else hard."""
    head = F.left(c, F.lit(budget))
    at = F.greatest(_last(head, "\n\n"), _last(head, ". "), _last(head, "\n"))
    cut = F.when(at > budget * 0.8, at).otherwise(F.lit(budget))
    return F.when(F.length(c) <= budget, c).otherwise(trim_all(F.left(head, cut.cast("int"))))


def split_sentences(c: Column) -> Column:
    """Sentences: after . ! or ? before a capital, quote or bracket, and at blank lines; abbreviations end none."""
    guarded = F.regexp_replace(c, "(?i)(?<![A-Za-z0-9_])(" + "|".join(a for a in ABBREVIATIONS) + ")\\.", "$1\u0001")
    guarded = F.replace(F.replace(F.replace(guarded, F.lit("e.g\u0001"), F.lit("e\u0001g\u0001")), F.lit("i.e\u0001"), F.lit("i\u0001e\u0001")), F.lit("U.S\u0001"), F.lit("U\u0001S\u0001"))
    parts = F.split(guarded, f"(?<=[.!?])[{WS}]+(?=[A-Z\"'(\\[])|\\n{{2,}}")
    return F.filter(F.transform(parts, lambda s: trim_all(F.replace(s, F.lit("\u0001"), F.lit(".")))), lambda s: s != "")


def entity_key(c: Column) -> Column:
    """The key under which mentions of an entity are merged: upper case, single blanks."""
    return F.upper(F.regexp_replace(trim_all(c), f"[{WS}]+", " "))


def entity_name(c: Column) -> Column:
    """The form in which entity names are looked for in questions."""
    return trim_all(F.regexp_replace(F.regexp_replace(F.lower(c), f"[^\\p{{L}}\\p{{N}}{WS}]", " "), f"[{WS}]+", " "))


def near_duplicate_key(c: Column) -> Column:
    """The first 120 characters in lower case with single blanks."""
    return F.regexp_replace(F.lower(F.left(c, F.lit(120))), f"[{WS}]+", " ")


def context_header(category: Column, title: Column, headings: Column) -> Column:
    """A chunk's place as one line: category unless uploaded, title without extension, headings."""
    name = F.regexp_replace(title, "\\.[^.]+$", "")
    first = F.when(category == "uploaded", F.array().cast("array<string>")).otherwise(F.array(category))
    parts = F.concat(F.coalesce(first, F.array().cast("array<string>")), F.array(name), F.coalesce(headings, F.array().cast("array<string>")))
    return F.concat(F.lit("[Context: "), F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), " > "), F.lit("]\n"))


def context_block(rank: Column, title: Column, headings: Column, body: Column) -> Column:
    """One passage as it stands in a prompt, with its number and source."""
    source = F.concat_ws(" > ", title, F.when(F.size(headings) > 0, F.array_join(headings, " > ")))
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] (source: "), source, F.lit(")\n"), F.left(body, F.lit(4000)))


def salvage_json(c: Column) -> Column:
    """The JSON of a reply: all of it, else what stands between its first and last brace, else null."""
    inner = F.regexp_extract(c, "(?s)\\{.*\\}", 0)
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(F.when(inner != "", inner)))


# Formatters; null and not finite values give a dash.


def _or_dash(c: Column, shown: Column) -> Column:
    d = c.cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), F.lit("—")).otherwise(shown)


def format_score(c: Column) -> Column:
    """Three decimals."""
    return _or_dash(c, F.format_string("%.3f", c.cast("double")))


def format_percent(c: Column, digits: int = 0) -> Column:
    """A share as a percentage."""
    return _or_dash(c, F.format_string(f"%.{digits}f%%", c.cast("double") * 100))


def format_cost(c: Column) -> Column:
    """Dollars, with more decimals the smaller the amount."""
    d = c.cast("double")
    show = lambda n: F.format_string(f"$%.{n}f", d)
    return _or_dash(c, F.when(d == 0, "$0").when(d < 0.001, show(6)).when(d < 0.01, show(5)).when(d < 1, show(4)).otherwise(show(2)))


def format_tokens(c: Column) -> Column:
    """A count, in thousands or millions from there on."""
    d = c.cast("double")
    return _or_dash(c, F.when(d >= 1e6, F.format_string("%.1fM", d / 1e6)).when(d >= 1e3, F.format_string("%.1fk", d / 1e3)).otherwise(F.format_string("%d", F.floor(d + 0.5))))


def format_duration(c: Column) -> Column:
    """Milliseconds as ms, s or minutes and seconds."""
    d = c.cast("double")
    minutes = F.format_string("%dm %ds", F.floor(d / 60000), F.floor(F.pmod(d, F.lit(60000.0)) / 1000 + 0.5))
    return _or_dash(c, F.when(d < 1000, F.format_string("%d ms", F.floor(d + 0.5))).when(d < 60000, F.format_string("%.2f s", d / 1000)).otherwise(minutes))


def format_bytes(c: Column) -> Column:
    """Bytes as B, KB or MB."""
    d = c.cast("double")
    return _or_dash(c, F.when(d >= 1048576, F.format_string("%.1f MB", d / 1048576)).when(d >= 1024, F.format_string("%.0f KB", d / 1024)).otherwise(F.format_string("%d B", d.cast("bigint"))))


def format_delta(c: Column) -> Column:
    """A relative change with its sign; empty for null."""
    d = c.cast("double")
    return F.when(d.isNull(), F.lit("")).otherwise(F.concat(F.when(d > 0, "+").otherwise(""), F.format_string("%.1f%%", d * 100)))
