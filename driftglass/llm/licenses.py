"""License scans over a positional rare-token index (operator 8). DataFrame operations only."""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftglass.llm.common import table

#: The phrases whose places are counted, with their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: The method's templates: label, words, and the phrase that must stand in it.
TEMPLATES = (
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("gpl", "licensed under the gnu general public license version 3", "gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "distribute this software for any purpose"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    ("mpl", "subject to the terms of the mozilla public license version 2 0", "mozilla public license"),
)
#: A word is a run of characters other than these.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
VOCABULARY = sorted({w for p in (*BASE, *(t for _, t, _ in TEMPLATES)) for w in p.split()})


def words(text: Column) -> Column:
    """lower() also lowers letters beyond A-Z; that moves no word boundary, and no word of the vocabulary comes from one, as
    none has a k (the only ASCII letter that a letter beyond A-Z lowers to by itself)."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NO_WORD), "")


def rarity(docs: DataFrame) -> dict[str, float]:
    """The IDF of each licence word over all of docs. As many values as the vocabulary has words come to the driver."""
    found = docs.select(F.explode(F.array_intersect(words(F.col("text")), F.array(*map(F.lit, VOCABULARY)))).alias("word"))
    df = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = docs.count()
    return {w: log(1 + (n + 1) / (df.get(w, 0) + 0.5)) for w in VOCABULARY}


def _at(word: str, offset: int) -> Column:
    """A word's postings, moved back by its offset in a phrase."""
    return F.transform(F.filter("postings", lambda p: p["w"] == word), lambda p: p["at"] - offset)


def _starts(words_at: list[tuple[str, int]], idf: dict[str, float]) -> Column:
    """The places where all words stand at their offsets: postings, moved back by the offset, intersected from the rarest on."""
    lists = [_at(w, o) for w, o in sorted(words_at, key=lambda x: (-idf[x[0]], x[1]))]
    meet = reduce(F.array_intersect, lists)
    rarest = max((w for w, _ in words_at), key=lambda w: idf[w])
    return F.when(F.array_contains("present", rarest), meet).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, idf: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs (doc_id, text).

    Index: a file's postings are its licence words with positions, kept only where it has one of the rare words (each phrase's
    word of highest IDF). A phrase's places are the intersection of its words' postings by relative position. A template's
    label is given where its key phrase stands; its score is the IDF share of its words that stand in place round the key
    phrase, and a row's score the highest of those (0 without any).

    Null or empty text: no words, no labels (empty strings), null places, score 0. Null doc_id and repeated rows: rows as any
    other. Empty table: no rows. Columns beyond doc_id and text are left out. Very long
    texts are scanned whole. Ties among words of one IDF go to the first by offset, and change no place, label or score.
    """
    idf = idf or rarity(docs)
    phrases = [p.split() for p in BASE] + [k.split() for _, _, k in TEMPLATES]
    rare = sorted({max(p, key=lambda w: idf[w]) for p in phrases})
    rows = docs.select("doc_id", words(F.col("text")).alias("words"))
    rows = rows.withColumn("present", F.array_intersect("words", F.array(*map(F.lit, VOCABULARY))))
    placed = F.filter(F.transform("words", lambda w, i: F.when(w.isin(*VOCABULARY), F.struct(i.alias("at"), w.alias("w")))), lambda p: p.isNotNull())
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), "present", F.when(F.arrays_overlap("present", F.array(*map(F.lit, rare))), placed).otherwise(F.array().cast("array<struct<at:int,w:string>>")).alias("postings"))
    base = {f"b{i}": _starts([(w, o) for o, w in enumerate(p.split())], idf) for i, p in enumerate(BASE)}
    keys = {}
    for i, (_, words_in, key) in enumerate(TEMPLATES):
        ws, ks = words_in.split(), key.split()
        at = next(j for j in range(len(ws)) if ws[j : j + len(ks)] == ks)
        keys[f"k{i}"] = _starts([(w, at + o) for o, w in enumerate(ks)], idf)
    rows = rows.withColumns(base | keys)
    scores = {}
    for i, (_, words_in, _) in enumerate(TEMPLATES):
        ws = words_in.split()
        lists = F.array(*[F.struct(_at(w, o).alias("at"), F.lit(idf[w]).alias("idf")) for o, w in enumerate(ws)])
        start = F.struct(F.col(f"k{i}").alias("at"), F.lit(0.0).alias("sum"))

        def fit(a: Column, x: Column) -> Column:
            both = F.array_intersect(a["at"], x["at"])
            return F.when(F.size(both) > 0, F.struct(both.alias("at"), (a["sum"] + x["idf"]).alias("sum"))).otherwise(a)

        whole = reduce(lambda a, w: a + idf[w], ws, 0.0)  # in the order of the fold, so that a whole match scores exactly 1
        share = F.aggregate(lists, start, fit, lambda a: a["sum"] / whole)
        scores[f"s{i}"] = F.when(F.size(f"k{i}") > 0, share).otherwise(0.0)
    rows = rows.withColumns(scores)
    places = F.concat(*base)
    named = [F.when(F.size(b) > 0, F.lit(label)) for b, label in zip(base, BASE.values(), strict=True)]
    own = [F.when(F.size(f"k{i}") > 0, F.lit(t[0])) for i, t in enumerate(TEMPLATES)]
    joined = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.filter(F.array(*xs), lambda x: x.isNotNull()))), ",")
    return rows.select(
        "doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        joined(named).alias("base_labels"),
        joined([*named, *own]).alias("labels"),
        F.least(F.lit(1.0), F.greatest(*scores)).alias("score"),
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
