"""32-bit hashes as column expressions: FNV-1a for ids, a two-argument mixer for placement. Values are LONGs in 0 .. 2^32 - 1."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = 0xFFFFFFFF
#: FNV-1a's seed and prime, the seed of the embedder's signs, and the mixer's three constants.
FNV_SEED, FNV_PRIME, SIGN_SEED = 0x811C9DC5, 0x01000193, 0x9E3779B1
MIX_XOR, MIX_FIRST, MIX_SECOND = 0x9E3779B9, 0x85EBCA6B, 0xC2B2AE35


def imul32(a: Column, k: int) -> Column:
    """a * k mod 2^32. The product is made of 16-bit halves of a, so that no step leaves a LONG (ANSI mode raises there)."""
    low = (a.bitwiseAND(65535) * F.lit(k).cast("long")).bitwiseAND(U32)
    high = (F.shiftright(a, 16) * F.lit(k).cast("long")).bitwiseAND(65535) * 65536
    return (low + high).bitwiseAND(U32)


def fnv1a(text: Column, seed: int = FNV_SEED) -> Column:
    """FNV-1a over a text's UTF-16 units: a character beyond U+FFFF counts as its two surrogates."""
    codes = F.when(F.length(text) > 0, F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))).otherwise(F.array().cast("array<long>"))
    put = lambda h, unit: (h.bitwiseXOR(unit) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(U32)
    pair = lambda h, c: put(put(h, F.shiftright(c - 0x10000, 10) + 0xD800), (c - 0x10000).bitwiseAND(0x3FF) + 0xDC00)
    return F.aggregate(codes, F.lit(seed).cast("long"), lambda h, c: F.when(c > 0xFFFF, pair(h, c)).otherwise(put(h, c)))


#: Texts that are hashed side by side at least; the last few, the longest, go one by one.
SIDE_BY_SIDE = 24


def fnv1a_on(h: np.ndarray, units: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """FNV-1a going on from the states h over texts' units, each text's from its start on: unit by unit, over all that are long enough."""
    order = np.argsort(-sizes)
    start, sizes, h = start[order], sizes[order], h[order]
    done = int(sizes[SIDE_BY_SIDE - 1]) if len(h) >= SIDE_BY_SIDE else 0
    active = np.searchsorted(-sizes, -np.arange(1, done + 1), "right")
    for i, k in enumerate(active.tolist()):
        h[:k] = (h[:k] ^ units[start[:k] + i]) * np.uint32(FNV_PRIME)
    for j in range(min(SIDE_BY_SIDE - 1, len(h))):
        x = int(h[j])
        for unit in units[start[j] + done : start[j] + sizes[j]].tolist():
            x = ((x ^ unit) * FNV_PRIME) & U32
        h[j] = x
    out = np.empty_like(h)
    out[order] = h
    return out


def fnv1a_of(texts: list[str], seed: int = FNV_SEED) -> np.ndarray:
    """fnv1a() of many texts at once."""
    raw = [t.encode("utf-16-le", "surrogatepass") for t in texts]
    sizes = np.array([len(r) // 2 for r in raw], np.int64)
    return fnv1a_on(np.full(len(raw), seed, np.uint32), np.frombuffer(b"".join(raw), "<u2"), np.cumsum(sizes) - sizes, sizes).astype(np.int64)


def mix32(a: Column, b: Column) -> Column:
    """An avalanche of two 32-bit numbers: xor, multiply, fold, multiply, fold."""
    h = a.cast("long").bitwiseXOR(F.lit(MIX_XOR).cast("long")).bitwiseAND(U32)
    h = imul32(h.bitwiseXOR(b.cast("long")).bitwiseAND(U32), MIX_FIRST)
    h = imul32(h.bitwiseXOR(F.shiftright(h, 13)), MIX_SECOND)
    return h.bitwiseXOR(F.shiftright(h, 16))


def message_id(*parts: Column) -> Column:
    """A 32-bit id for a message, the same on each run: the first bits of its parts' MD5."""
    return F.conv(F.left(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), F.lit(8)), 16, 10).cast("long")


def node_id(public_key_hex: Column) -> Column:
    """A node's id: its key hashed; 0 means everybody, so it becomes 1."""
    h = fnv1a(public_key_hex)
    return F.when(h == 0, F.lit(1)).otherwise(h)
