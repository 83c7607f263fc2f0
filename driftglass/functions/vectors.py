"""Vectors as arrays: dot products, int8 quantisation, wire scores, the hashing embedder. DOUBLE throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMBED_DIM = 384
#: What a word, a pair of words and four letters of a word weigh in the embedder.
WORD, PAIR, LETTERS, N_LETTERS = 1.0, 0.7, 0.35, 4


def rounded(x: Column) -> Column:
    """Half up, also below zero (round() goes away from zero there)."""
    return F.floor(x + 0.5)


def dot(a: Column, b: Column) -> Column:
    """Summed in order; the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a / |a|; a itself where it is zero."""
    return F.transform(F.array(F.struct(a.alias("v"), norm(a).alias("n"))), lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x / s["n"])).otherwise(F.transform(s["v"], lambda x: x.cast("double"))))[0]


def quantize(a: Column) -> Column:
    """struct(q array<tinyint>, scale): scale is the largest magnitude / 127, or 1 for a zero vector."""
    top = F.coalesce(F.array_max(F.transform(a, lambda x: F.abs(x.cast("double")))), F.lit(0.0)) / 127
    scale = F.when(top > 0, top).otherwise(1.0)
    q = lambda s: F.transform(s["v"], lambda x: F.least(F.lit(127), F.greatest(F.lit(-127), rounded(x.cast("double") / s["scale"]))).cast("tinyint"))
    return F.transform(F.array(F.struct(a.alias("v"), scale.alias("scale"))), lambda s: F.struct(q(s).alias("q"), s["scale"].alias("scale")))[0]


def dequantize(q: Column, scale: Column) -> Column:
    """Back to a unit vector."""
    return unit(F.transform(q, lambda x: x.cast("double") * scale))


def wire_score(cosine: Column) -> Column:
    """-1 .. 1 as 16 bits: 0 .. 65535."""
    return rounded(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (cosine + 1) / 2)) * 65535).cast("int")


def from_wire_score(score: Column) -> Column:
    return score / F.lit(65535.0) * 2 - 1


def embedding_input(title: Column, section: Column, text: Column, dash: str = "-") -> Column:
    return F.concat(title, F.lit(f" {dash} "), section, F.lit(". "), text)
