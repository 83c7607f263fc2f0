"""Byte-level BPE against an encoder in plain Python, against the tokenizer library, and back to the same bytes."""

import base64
import hashlib
import random

import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from driftglass.llm import byte_bpe

DATA = "/root/testdata/sf0.001"
RAW, PATTERN = byte_bpe.read_vocabulary()
RANKS = byte_bpe.ranks_of(RAW)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def brute(word, ranks=RANKS):
    """One word's ids: the leftmost pair of the least rank is contracted, one at a time."""
    if word in ranks:
        return [ranks[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def coded(coder, texts, pattern=PATTERN):
    ids = [[] for _ in texts]
    for words in byte_bpe.words_of(iter(texts), pattern):
        for row in coder.encode(words).to_pylist():
            ids[row["doc"]] += row["ids"]
    return ids


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.Coder(RAW)


TEXTS = [
    "", " ", "a", "Hello, world! It's 2024 & we're here.", "  two  blanks\n\n\tand tabs \r\n", "naïve café – “quoted” …", "日本語のテキスト、そして中文字符", "🙂🙃👩‍👩‍👧 mixed", "a" * 3000, "=" * 1777,
    " " * 2500 + "x", "\n" * 999, "ab" * 700, "aab" * 500 + "a", "<|endoftext|> is text", "\x00\x01\x7f", "I'LL i'll 'LL'll", "٣٤٥ ⅷ ½", "　 wide blanks\u0085", "é combining", "tab\x1cfile\x1fseparators",
]


def test_library_and_brute_force(coder):
    r = random.Random(8)
    syllables = ["ka", "lo", "ing", "er", "tion", "sch", "ü", "ñ", "Q", "qu", "the", "x"]
    texts = TEXTS + [" ".join("".join(r.choices(syllables, k=r.randint(1, 9))) for _ in range(60)) for _ in range(40)] + ["".join(r.choices(syllables, k=2500))]
    texts += ["".join(chr(r.choice([r.randint(1, 0xD7FF), r.randint(0xE000, 0x10FFFF), r.randint(32, 126)])) for _ in range(300)) for _ in range(20)]
    got = coded(coder, texts)
    assert got == [LIBRARY.encode_ordinary(t) for t in texts]
    for text, ids in zip(texts[: len(TEXTS) - 1], got, strict=False):
        if len(text) < 800:
            assert ids == [i for w in regex.findall(PATTERN, text) for i in brute(w.encode())]
    back = {row["doc"]: row["raw"] for row in coder.decode(pa.table({"doc": pa.array(range(len(got)), pa.int32()), "ids": pa.array(got, pa.list_(pa.int32()))})).to_pylist()}
    assert all(back.get(i, b"") == t.encode() for i, t in enumerate(texts))


@pytest.mark.parametrize("seed", range(6))
def test_vocabularies_whose_tokens_rank_below_their_parts(seed):
    """Random vocabularies, in which contracting a pair may make one of a lower rank, and pairs of one rank overlap."""
    r = random.Random(seed)
    tokens = [bytes([b]) for b in range(256)]
    more = list({bytes(r.choices(b"abc", k=r.randint(2, 5))) for _ in range(60)})
    r.shuffle(more)
    own = tokens + more
    ranks = {t: i for i, t in enumerate(own)}
    raw = b"\n".join(base64.b64encode(t) + b" %d" % i for t, i in ranks.items())
    texts = ["".join(r.choices("abc", k=r.randint(1, 40))) for _ in range(300)] + ["a" * 50, "ab" * 30, "abc" * 20]
    assert any(m[3] for m in byte_bpe.merges_of(ranks))
    assert coded(byte_bpe.Coder(raw), texts) == [brute(t.encode(), ranks) for t in texts]


def test_words_are_forgotten_and_texts_are_cut(coder, monkeypatch):
    text = " ".join(f"word{i} längre{i % 7}" for i in range(400))
    want = LIBRARY.encode_ordinary(text)
    monkeypatch.setattr(byte_bpe, "A_BATCH", 50)
    monkeypatch.setattr(byte_bpe, "A_TABLE", 20)
    assert len(list(byte_bpe.words_of(iter([text, "x"]), PATTERN))) > 20
    assert coded(coder, [text, "", text]) == [want, [], want]


def test_bytes_without_a_token():
    with pytest.raises(ValueError, match="without a token"):
        byte_bpe.Coder(b"YQ== 0\n")


EDGES = [(1, None), (2, ""), (3, "hello world"), (3, "hello world"), (None, "null id"), (4, "word " * 100_000), (5, "é" * 50_000), (6, "\n")]


@pytest.mark.parametrize("extra", [False, True])
def test_operators(spark, extra):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string").repartition(3)
    if extra:
        for c in ("ids", "raw", "pos", "word", "doc", "n_tokens"):
            docs = docs.withColumn(c, F.lit("clash"))
    ids = byte_bpe.encoded(docs)
    want = sorted(((i, LIBRARY.encode_ordinary(t or "")) for i, t in EDGES), key=str)
    assert sorted(((r["doc_id"], r["ids"]) for r in ids.collect()), key=str) == want
    assert sorted(((r["doc_id"], bytes(r["raw"])) for r in byte_bpe.decoded(ids).collect()), key=str) == sorted(((i, (t or "").encode()) for i, t in EDGES), key=str)
    assert byte_bpe.encoded(docs.limit(0)).count() == byte_bpe.round_trip(docs.limit(0)).count() == 0


def test_ids_that_are_no_tokens(spark):
    rows = spark.createDataFrame([(1, [], ), (2, None), (3, [50255])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: bytes(r["raw"]) for r in byte_bpe.decoded(rows).collect()} == {1: b"", 2: b"", 3: LIBRARY.decode_bytes([50255])}
    with pytest.raises(Exception, match="no token"):
        byte_bpe.decoded(spark.createDataFrame([(1, [70_000])], "doc_id long, ids array<int>")).collect()


def test_query(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = byte_bpe.op12(spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIBRARY.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
