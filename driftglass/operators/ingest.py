"""Documents to passages: sections and chunks, the three tables, corpus manifest and storage figures."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftglass.functions.hashing import fnv1a_of
from driftglass.functions.identity import content_intact, document_hash
from driftglass.functions.text import body_word_count, title_of, trimmed
from driftglass.session import spread

#: Characters that a passage takes, and those of its snippet; fixed bytes of a metadata row.
PASSAGE_CHARS, SNIPPET_CHARS, META_BYTES = 1200, 200, 404
#: Documents that are packed and hashed at once.
DOCUMENTS = 512
_PASSAGES = pa.schema([("doc_key", pa.int64()), ("seq", pa.int32()), ("title", pa.string()), ("source", pa.string()), ("section", pa.string()), ("text", pa.string()), ("doc_id", pa.int64())])


def parsed(docs: DataFrame, filename: str = "filename", text: str = "text", stated: Column | None = None) -> DataFrame:
    """docs plus title, source and sections (array of struct(section, lines)).

    `# ` lines are titles (the last one counts), `## ` lines start sections, a `source:` line names the source; none of them is
    body text. Text before the first section has an empty section name.
    """
    stated = F.lit(None).cast("string") if stated is None else stated
    body = F.concat(F.lit("\n"), F.col(text))
    body = F.regexp_replace(F.regexp_replace(body, r"\n#[ \t][^\n]*", "\n"), r"(?i)\nsource:[^\n]*", "\n")
    parts = F.split(body, "\n##[ \t]+")
    heads = F.transform(parts, lambda p, i: F.struct(
        F.when(i == 0, "").otherwise(F.trim(F.substring_index(p, "\n", 1))).alias("section"),
        F.filter(F.transform(F.split(F.when(i == 0, p).otherwise(F.when(p.contains("\n"), F.regexp_replace(p, "^[^\n]*\n", "")).otherwise("")), "\n"), trimmed), lambda s: s != "").alias("lines"),
    ))
    source = F.coalesce(F.nullif(F.trim(F.regexp_extract(F.col(text), r"(?im)^source:[ \t]*(.*)$", 1)), F.lit("")), F.col(filename))
    return docs.withColumns({"title": title_of(stated, F.col(text), F.col(filename)), "source": source, "sections": F.filter(heads, lambda h: F.size(h["lines"]) > 0)})


_SENTENCE = re.compile(r"(?<=[.!?])\s+", re.ASCII)


def packed(lines: list[str], cap: int) -> list[str]:
    """Lines as passages: each takes lines as long as it stays within the cap; a longer line is cut after sentences, and where a
    sentence is longer still, at the cap."""
    done, open_, size = [], [], 0
    for line in lines:
        for part in [line] if len(line) <= cap else _SENTENCE.split(line):
            for piece in [part] if len(part) <= cap else [part[i : i + cap] for i in range(0, len(part), cap)]:
                if not size:
                    open_, size = [piece], len(piece)
                elif size + 1 + len(piece) <= cap:
                    open_.append(piece)
                    size += 1 + len(piece)
                else:
                    done.append("\n".join(open_))
                    open_, size = [piece], len(piece)
    return [*done, "\n".join(open_)] if size else done


def passages(docs: DataFrame, filename: str = "filename", text: str = "text", cap: int = PASSAGE_CHARS) -> DataFrame:
    """(doc_key, doc_id, seq, title, source, section, text): docs' passages, content-addressed. Documents are parsed by expressions;
    packing and hashing, which go character by character, are one vectorised pass over each batch. Documents without body text have no
    passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), DOCUMENTS):
                part = batch.slice(at, DOCUMENTS).to_pylist()
                found = [[(s["section"], t) for s in r["sections"] for t in packed(s["lines"], cap)] for r in part]
                keys = fnv1a_of(["\n".join(x for x in (r["title"], "\n".join(t for _, t in own)) if x is not None) for r, own in zip(part, found, strict=True)])
                rows = [(int(k), seq, r["title"], r["source"], s, t) for r, k, own in zip(part, keys, found, strict=True) for seq, (s, t) in enumerate(own)]
                if rows:
                    ids = fnv1a_of([f"{k}:{seq}:{t}" for k, seq, _, _, _, t in rows])
                    columns = [pa.array(c, f.type) for c, f in zip([*zip(*rows, strict=True), ids], _PASSAGES, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, schema=_PASSAGES)

    rows = parsed(spread(docs.select(filename, text)), filename, text).where(F.size("sections") > 0).select("title", "source", "sections")
    return rows.mapInArrow(run, "doc_key long, seq int, title string, source string, section string, text string, doc_id long")


def tables(rows: DataFrame, holds: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, meta, bodies) from passages. holds: which passages' bodies are kept; all by default, their metadata in any case."""
    docs = rows.groupBy("doc_key", "title", "source").agg(F.sum(F.length("text")).alias("bytes"), F.count(F.lit(1)).alias("chunk_count"))
    meta = rows.select("doc_id", "doc_key", "seq", "title", "section", F.left("text", F.lit(SNIPPET_CHARS)).alias("snippet"), F.length("text").alias("bytes"), F.lit(1).alias("version"))
    return docs, meta, (rows if holds is None else rows.where(holds)).select("doc_id", "doc_key", "seq", "text")


def _same_passage(meta: DataFrame, bodies: DataFrame) -> list[str]:
    """The columns that tell whose body it is: ids have 32 bits, which different passages share now and then, so document and place
    are compared too where both tables have them."""
    return [c for c in ("doc_id", "doc_key", "seq") if c in meta.columns and c in bodies.columns]


def shown_text(meta: DataFrame, bodies: DataFrame) -> DataFrame:
    """(doc_id, text, held): a passage's body where that is held, else its snippet. A row for each of meta."""
    on = _same_passage(meta, bodies)
    held = bodies.select(*on, "text", F.lit(True).alias("_held")).dropDuplicates(on)
    rows = meta.select(*on, "snippet").join(held, on, "left")
    return rows.select("doc_id", F.coalesce("text", "snippet").alias("text"), F.coalesce("_held", F.lit(False)).alias("held"))


def document_counts(meta: DataFrame, bodies: DataFrame) -> DataFrame:
    """(doc_key, known, stored). A passage counts once for each row of meta and body it has: bodies without document and place are
    all those of its id."""
    on = _same_passage(meta, bodies)
    held = bodies.select(*on, F.lit(True).alias("held"))
    held = held.distinct() if "doc_key" in on else held
    return meta.join(held, on, "left").groupBy("doc_key").agg(F.count(F.lit(1)).alias("known"), F.count_if(F.coalesce("held", F.lit(False))).alias("stored"))


def catalog_stats(docs: DataFrame, meta: DataFrame, bodies: DataFrame, budget: int = 1 << 20) -> DataFrame:
    """One row: documents, known, stored, meta_bytes, body_chars, free_bytes."""
    m = meta.agg(F.count(F.lit(1)).alias("known"), F.coalesce(F.sum(META_BYTES + F.length("title") + F.length("section") + F.length("snippet")), F.lit(0)).alias("meta_bytes"))
    b = bodies.agg(F.count(F.lit(1)).alias("stored"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("body_chars"))
    one = docs.agg(F.count(F.lit(1)).alias("documents")).join(m).join(b)  # one row each
    return one.withColumn("free_bytes", F.greatest(F.lit(0), F.lit(budget) - F.col("meta_bytes") - F.col("body_chars")))


def described(meta: DataFrame, docs: DataFrame) -> DataFrame:
    """meta (doc_id, doc_key, …) with the title and source of its document (doc_key, title, source), empty where that is unknown."""
    named = docs.select("doc_key", F.col("title").alias("doc_title"), F.col("source").alias("doc_source"))
    return meta.join(named, "doc_key", "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("doc_title", "doc_source")})


def purged(rows: DataFrame, provenance: str = "provenance", what: str = "seed") -> DataFrame:
    """rows less those of a provenance; rows of unknown provenance stay."""
    return rows.where(F.col(provenance).isNull() | (F.col(provenance) != what))


def intact_documents(docs: DataFrame, meta: DataFrame, bodies: DataFrame) -> DataFrame:
    """(doc_key, intact) for docs (doc_key, title, doc_hash, chunk_count): whether the passages held (meta: doc_id, doc_key, seq;
    bodies: doc_id, text), in order, hash to what was announced; null where the hash or a passage is missing."""
    rows = meta.select("doc_id", "doc_key", "seq").join(bodies.select("doc_id", "text"), "doc_id")
    held = rows.groupBy("doc_key").agg(F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("_rows"))
    rows = docs.join(held, "doc_key", "left")
    actual = document_hash(F.col("title"), F.array_join(F.transform("_rows", lambda r: r["text"]), "\n"))
    known = F.when(F.col("doc_hash") != "", F.col("doc_hash"))
    return rows.select("doc_key", content_intact(known, actual, F.coalesce("_n", F.lit(0)), F.col("chunk_count")).alias("intact"))


def manifest(docs: DataFrame, by: str) -> DataFrame:
    """(by, documents, bytes, words) of texts."""
    return docs.groupBy(by).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.octet_length("text")).alias("bytes"), F.sum(body_word_count(F.col("text")).cast("long")).alias("words"))


def legacy_documents(chunks: DataFrame) -> DataFrame:
    """Documents of a flat chunk table (doc_key, seq, title, text, added_at): earliest time, size, count and first title."""
    return chunks.groupBy("doc_key").agg(F.min("added_at").alias("created_at"), F.sum(F.length("text")).alias("bytes"), F.count(F.lit(1)).alias("chunk_count"), F.min_by("title", F.struct("seq", "title")).alias("title"))
