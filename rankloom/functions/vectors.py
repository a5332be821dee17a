"""Vector and number functions as column expressions; products are accumulated in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    """The inner product over the shorter length; null if one is null."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where a vector is all zero."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def l2_normalize(a: Column) -> Column:
    """The vector at unit length in single precision; one of all zeros stays as it is."""
    n = norm(a)
    return F.when(n == 0, a).otherwise(F.transform(a, lambda x: (x.cast("double") / n).cast("float")))


def reference_similarity(a: Column, b: Column) -> Column:
    """Cosine similarity, not below 0; 0 where it can't be had."""
    return F.greatest(F.lit(0.0), F.coalesce(cosine(a, b), F.lit(0.0)))


def vector_literal(a: Column) -> Column:
    """A vector as text, [0.1,0.2]."""
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ","), F.lit("]"))


def parse_vector(c: Column) -> Column:
    """The vector of such a text."""
    return F.split(F.trim(c, F.lit("[]")), ",").cast("array<float>")


def clamp01(c: Column) -> Column:
    """Between 0 and 1; 0 for null and what isn't finite."""
    fine = F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), fine))


def gain(grade: Column) -> Column:
    """What a relevance grade is worth: 2 to its power, less 1."""
    return F.pow(F.lit(2.0), clamp01(grade)) - 1


def discount(rank: Column) -> Column:
    """How much less a later rank is worth."""
    return 1 / F.log2(rank + 1)


def clamp_weight(c: Column) -> Column:
    """A relationship's weight between 1 and 10; 5 for null and what isn't finite."""
    d = c.cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), F.lit(5.0)).otherwise(F.least(F.lit(10.0), F.greatest(F.lit(1.0), d)))


def relative_delta(value: Column, base: Column) -> Column:
    """The change relative to a base; null if that is 0."""
    return F.try_divide(value - base, base)


def index_bytes(dimensions: Column, text: Column, embed_text: Column) -> Column:
    """Memory of an indexed chunk: four bytes a dimension, two a character."""
    return 4 * dimensions + 2 * F.length(text) + 2 * F.length(embed_text)


# Dollars for a million tokens of input, cached input and output.
PRICES = {
    "gpt-5-nano": (0.05, 0.005, 0.4),
    "gpt-5-mini": (0.25, 0.025, 2.0),
    "gpt-5": (1.25, 0.125, 10.0),
    "text-embedding-3-small": (0.02, 0.02, 0.0),
    "text-embedding-3-large": (0.13, 0.13, 0.0),
}
FALLBACK_PRICE = (0.05, 0.005, 0.4)


def call_cost(model: Column, inputs: Column, cached: Column, outputs: Column) -> Column:
    """Dollars for a call; a date at the end of the model's name is dropped, an unknown model has the fallback price."""
    name = F.regexp_replace(model, "-\\d{4}-\\d{2}-\\d{2}$", "")

    def price(k: int) -> Column:
        table = F.create_map(*[x for m, p in PRICES.items() for x in (F.lit(m), F.lit(p[k]))])
        return F.coalesce(table[name], F.lit(FALLBACK_PRICE[k]))

    fresh = F.greatest(F.lit(0), inputs - cached)
    return (fresh * price(0) + cached * price(1) + outputs * price(2)) / 1e6
