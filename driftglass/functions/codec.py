"""Packet headers, frames and fixed-width fields over BINARY columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Header: version, type, ttl, flags (a byte each), message, source and destination id (four each), big-endian.
HEADER, VERSION, FRAME_HEADER, MOST_FRAMES = 16, 3, 6, 255
TYPES = ("HELLO", "QUERY", "HIT", "RESULT", "DOC_REQ", "DOC_RES", "ANNOUNCE", "CATALOG_REQ", "IDENT_REQ", "IDENT_RES", "HOLDERS", "ACK")


def unsigned(n: Column, size: int) -> Column:
    """n as `size` bytes, big-endian."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2 * size, "0"))


def number(b: Column, at: int | Column, size: int) -> Column:
    """The unsigned number in `size` bytes from place `at` (0 first)."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substring(b, at + 1, F.lit(size))), 16, 10).cast("long")


def to_base64(b: Column) -> Column:
    """Base 64 on one line."""
    return F.regexp_replace(F.base64(b), r"\s", "")


def from_base64(text: Column) -> Column:
    return F.unbase64(text)


def to_hex(b: Column) -> Column:
    return F.lower(F.hex(b))


def encode_packet(kind: Column, ttl: Column, flags: Column, msg: Column, src: Column, dst: Column, payload: Column, version: int = VERSION) -> Column:
    return F.concat(unsigned(F.lit(version), 1), unsigned(kind, 1), unsigned(ttl, 1), unsigned(flags, 1), unsigned(msg, 4), unsigned(src, 4), unsigned(dst, 4), payload)


def decode_packet(b: Column, version: int = VERSION) -> Column:
    """struct(ver, type, ttl, flags, msg_id, src_id, dst_id, payload); null for a short packet or another version."""
    fields = [number(b, i, 1).cast("int").alias(n) for i, n in enumerate(("ver", "type", "ttl", "flags"))]
    fields += [number(b, 4 + 4 * i, 4).alias(n) for i, n in enumerate(("msg_id", "src_id", "dst_id"))]
    payload = F.substring(b, F.lit(HEADER + 1), F.greatest(F.octet_length(b) - HEADER, F.lit(0))).alias("payload")
    return F.when((F.octet_length(b) >= HEADER) & (number(b, 0, 1) == version), F.struct(*fields, payload))


def capped_utf8(text: Column, most: int) -> Column:
    """A u16 length and the first `most` bytes of a text's UTF-8. A character that the cap cuts reads back as U+FFFD."""
    raw = F.substring(F.encode(text, "UTF-8"), F.lit(1), F.lit(most))
    return F.concat(unsigned(F.octet_length(raw), 2), raw)


def fixed_width(b: Column, size: int) -> Column:
    return F.rpad(F.substring(b, F.lit(1), F.lit(size)), size, F.lit(b"\x00"))


def frames(packet: Column, frag_id: Column, mtu: int) -> Column:
    """array<struct(idx, cnt, data)>: the packet in frames of at most mtu bytes, each with a 6-byte header (fragment id, index,
    count); null where it takes more than MOST_FRAMES."""
    room = mtu - FRAME_HEADER
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(packet) / room)).cast("int")
    head = lambda i: F.concat(unsigned(frag_id, 4), unsigned(i, 1), unsigned(n, 1))
    one = lambda i: F.struct(i.alias("idx"), n.alias("cnt"), F.concat(head(i), F.substring(packet, i * room + 1, F.lit(room))).alias("data"))
    return F.when(n <= MOST_FRAMES, F.transform(F.sequence(F.lit(0), n - 1), one))


def frame_fields(data: Column) -> Column:
    """struct(frag_id, idx, cnt, body) of a frame."""
    body = F.substring(data, F.lit(FRAME_HEADER + 1), F.greatest(F.octet_length(data) - FRAME_HEADER, F.lit(0)))
    return F.struct(number(data, 0, 4).alias("frag_id"), number(data, 4, 1).cast("int").alias("idx"), number(data, 5, 1).cast("int").alias("cnt"), body.alias("body"))


def reassembled(idx: Column, cnt: Column, body: Column) -> Column:
    """Over the frames of one packet (repeats and any order): its bytes, or null while a frame is missing."""
    parts = F.sort_array(F.collect_set(F.struct(idx.alias("i"), F.hex(body).alias("h"))))
    return F.when(F.count_distinct(idx) == F.max(cnt), F.unhex(F.array_join(F.transform(parts, lambda p: p["h"]), "")))


def segment_capacity(mtu: Column | int) -> Column:
    """Payload bytes of a radio segment: three of link header and one of its own go, 512 at most."""
    return F.least(F.lit(mtu) - 3 if isinstance(mtu, int) else mtu - 3, F.lit(512)) - 1


def segments(frame: Column, mtu: int) -> Column:
    """array<struct(seq, data)>: a frame in radio segments, each with a byte of header: its number (7 bits) and whether it is the
    last one."""
    room = min(mtu - 3, 512) - 1
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(frame) / room)).cast("int")
    head = lambda i: unsigned(F.pmod(i, F.lit(128)) * 2 + (i == n - 1).cast("int"), 1)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("seq"), F.concat(head(i), F.substring(frame, i * room + 1, F.lit(room))).alias("data")))


def rejoined(data: Column, most: int = 96 * 1024) -> Column:
    """The frame that an array of segments makes, in order of arrival: a segment that is not the next one starts afresh if it is the
    first, and else nothing more is taken until the next first; null where no last segment came, or the frame is over `most` bytes."""
    state = F.struct(F.lit(0).alias("next"), F.lit("").alias("held"), F.lit(None).cast("string").alias("done"))

    def step(a: Column, d: Column) -> Column:
        head = number(d, 0, 1)
        seq, last = F.floor(head / 2).cast("int"), head % 2 == 1
        fits = (seq == F.pmod(a["next"], F.lit(128))) & (a["next"] >= 0) | (seq == 0)
        held = F.concat(F.when((seq == 0) & (F.pmod(a["next"], F.lit(128)) != 0), "").otherwise(a["held"]), F.substring(F.hex(d), 3, 1 << 30))
        on = F.struct(F.when(last, F.lit(0)).otherwise(F.when((seq == 0) & (F.pmod(a["next"], F.lit(128)) != 0), F.lit(1)).otherwise(a["next"] + 1)).alias("next"), F.when(last, "").otherwise(held).alias("held"), F.when(last & (F.length(held) <= 2 * most), held).otherwise(a["done"]).alias("done"))
        lost = F.struct(F.lit(-1).alias("next"), F.lit("").alias("held"), a["done"].alias("done"))
        return F.when(fits, on).otherwise(lost)

    return F.unhex(F.aggregate(data, state, step, lambda a: a["done"]))


# Payloads. Numbers are big-endian, texts have a u16 length; `at` counts bytes from 0.

#: Holders of an entry, and entries of a packet, at most; bytes that a text keeps.
MOST_HOLDERS, MOST_ENTRIES = 8, 255
NAME, QUERY_TEXT, HIT_TITLE, SNIPPET, TITLE, SECTION, BODY, SOURCE = 32, 160, 80, 200, 120, 100, 4000, 200


def float32(x: Column) -> Column:
    """The four bytes of an IEEE 754 single; numbers too small for a normal one are 0."""
    x = x.cast("float").cast("double")
    size = F.abs(x)
    guess = F.floor(F.log2(size))
    e = guess + F.when(size / F.pow(F.lit(2.0), guess) >= 2, 1).when(size / F.pow(F.lit(2.0), guess) < 1, -1).otherwise(0)
    bits = (e + 127) * 8388608 + F.rint((size / F.pow(F.lit(2.0), e) - 1) * 8388608)
    sign = F.when(x < 0, F.lit(2147483648)).otherwise(F.lit(0))
    return unsigned(F.when((size > 0) & (e >= -126), bits.cast("long") + sign).otherwise(F.lit(0)), 4)


def from_float32(b: Column, at: Column | int) -> Column:
    bits = number(b, at, 4)
    e, m = F.pmod(F.floor(bits / 8388608), F.lit(256)), bits % 8388608
    return F.when(bits % 2147483648 == 0, 0.0).otherwise(F.when(bits >= 2147483648, -1.0).otherwise(1.0) * (1 + m / 8388608) * F.pow(F.lit(2.0), e - 127))


def text_at(b: Column, at: Column | int) -> Column:
    """The text whose length stands at `at`; a character that was cut, or any bytes that are no character, are U+FFFD."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.make_valid_utf8(F.substring(b, at + 3, number(b, at, 2).cast("int")).cast("string"))


def after_text(b: Column, at: Column | int) -> Column:
    """Where what follows that text begins."""
    return (F.lit(at) if isinstance(at, int) else at) + 2 + number(b, at, 2).cast("int")


def int8_bytes(q: Column) -> Column:
    return F.unhex(F.array_join(F.transform(q, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(255)), 2, "0")), ""))


def hello(caps: Column, known: Column, stored: Column, documents: Column, free_kb: Column, name: Column) -> Column:
    return F.concat(unsigned(caps, 1), unsigned(known, 4), unsigned(stored, 4), unsigned(documents, 2), unsigned(free_kb, 4), capped_utf8(name, NAME))


def read_hello(b: Column) -> Column:
    fields = [number(b, at, size).alias(name) for name, at, size in (("caps", 0, 1), ("known", 1, 4), ("stored", 5, 4), ("documents", 9, 2), ("free_kb", 11, 4))]
    return F.struct(*fields, text_at(b, 15).alias("name"))


def query_payload(query_id: Column, top_k: Column, scale: Column, q: Column, text: Column) -> Column:
    return F.concat(unsigned(query_id, 4), unsigned(top_k, 1), unsigned(F.size(q), 2), float32(scale), int8_bytes(q), capped_utf8(text, QUERY_TEXT))


def read_query(b: Column) -> Column:
    dim = number(b, 5, 2).cast("int")
    signed = lambda i: (lambda u: (u - F.when(u >= 128, 256).otherwise(0)).cast("tinyint"))(number(b, i + 11, 1))
    q = F.when(dim > 0, F.transform(F.sequence(F.lit(0), dim - 1), signed)).otherwise(F.array().cast("array<tinyint>"))
    text = F.when(F.octet_length(b) > dim + 11, text_at(b, dim + 11)).otherwise("")
    return F.struct(number(b, 0, 4).alias("query_id"), number(b, 4, 1).alias("top_k"), from_float32(b, 7).alias("scale"), q.alias("q"), text.alias("text"))


def result_payload(query_id: Column, hops: Column, hits: Column) -> Column:
    """hits: array of struct(doc_id, score, holder, title, snippet); at most MOST_ENTRIES travel."""
    one = lambda h: F.hex(F.concat(unsigned(h["doc_id"], 4), unsigned(F.least(F.lit(65535), F.greatest(F.lit(0), F.floor(h["score"] * 65535 + 0.5))), 2), unsigned(h["holder"], 4), capped_utf8(h["title"], HIT_TITLE), capped_utf8(h["snippet"], SNIPPET)))
    some = F.slice(hits, 1, MOST_ENTRIES)
    return F.concat(unsigned(query_id, 4), unsigned(hops, 1), unsigned(F.size(some), 1), F.unhex(F.array_join(F.transform(some, one), "")))


def read_result(b: Column) -> Column:
    """struct(query_id, hops, hits)."""
    kind = "array<struct<doc_id:bigint,score:double,holder:bigint,title:string,snippet:string>>"
    start = F.struct(F.lit(6).alias("at"), F.array().cast(kind).alias("hits"))

    def step(a: Column, _: Column) -> Column:
        at = a["at"]
        second = after_text(b, at + 10)
        hit = F.struct(number(b, at, 4).alias("doc_id"), (number(b, at + 4, 2) / 65535).alias("score"), number(b, at + 6, 4).alias("holder"), text_at(b, at + 10).alias("title"), text_at(b, second).alias("snippet"))
        return F.struct(after_text(b, second).alias("at"), F.array_append(a["hits"], hit).alias("hits"))

    n = number(b, 5, 1).cast("int")
    hits = F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), start, step, lambda a: a["hits"])).otherwise(F.array().cast(kind))
    return F.struct(number(b, 0, 4).alias("query_id"), number(b, 4, 1).alias("hops"), hits.alias("hits"))


def document_request(doc_id: Column) -> Column:
    return unsigned(doc_id, 4)


def document_reply(doc_id: Column, title: Column, section: Column, text: Column, source: Column) -> Column:
    return F.concat(unsigned(doc_id, 4), capped_utf8(title, TITLE), capped_utf8(section, TITLE), capped_utf8(text, BODY), capped_utf8(source, SOURCE))


def read_document_reply(b: Column) -> Column:
    section = after_text(b, 4)
    text = after_text(b, section)
    return F.struct(number(b, 0, 4).alias("doc_id"), text_at(b, 4).alias("title"), text_at(b, section).alias("section"), text_at(b, text).alias("text"), text_at(b, after_text(b, text)).alias("source"))


def catalog_request(since_s: Column, most: Column) -> Column:
    return F.concat(unsigned(since_s, 4), unsigned(most, 2))


def read_catalog_request(b: Column) -> Column:
    return F.struct(number(b, 0, 4).alias("since_s"), number(b, 4, 2).alias("most"))


def _holders(ids: Column) -> Column:
    some = F.slice(ids, 1, MOST_HOLDERS)
    return F.concat(unsigned(F.size(some), 1), F.unhex(F.array_join(F.transform(some, lambda h: F.hex(unsigned(h, 4))), "")))


def holders_payload(doc_key: Column, entries: Column) -> Column:
    """entries: array of struct(doc_id, hits, holders), at most MOST_ENTRIES of MOST_HOLDERS holders each."""
    some = F.slice(entries, 1, MOST_ENTRIES)
    one = lambda e: F.hex(F.concat(unsigned(e["doc_id"], 4), unsigned(e["hits"], 4), _holders(e["holders"])))
    return F.concat(unsigned(doc_key, 4), unsigned(F.size(some), 1), F.unhex(F.array_join(F.transform(some, one), "")))


def read_holders(b: Column) -> Column:
    """struct(doc_key, entries)."""
    kind = "array<struct<doc_id:bigint,hits:bigint,holders:array<bigint>>>"
    start = F.struct(F.lit(5).alias("at"), F.array().cast(kind).alias("entries"))

    def step(a: Column, _: Column) -> Column:
        at, n = a["at"], number(b, a["at"] + 8, 1).cast("int")
        ids = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: number(b, at + 9 + 4 * i, 4))).otherwise(F.array().cast("array<bigint>"))
        entry = F.struct(number(b, at, 4).alias("doc_id"), number(b, at + 4, 4).alias("hits"), ids.alias("holders"))
        return F.struct((at + 9 + 4 * n).alias("at"), F.array_append(a["entries"], entry).alias("entries"))

    n = number(b, 4, 1).cast("int")
    return F.struct(number(b, 0, 4).alias("doc_key"), F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), start, step, lambda a: a["entries"])).otherwise(F.array().cast(kind)).alias("entries"))


def announce_payload(doc: Column, entries: Column) -> Column:
    """doc: struct(doc_key, title, source, bytes, chunk_count, origin_id, created_s, doc_hash binary, author_key, sig); key and
    signature travel only as a pair. entries: array of struct(doc_id, seq, version, bytes, origin_id, hits, section, snippet, scale,
    q, holders)."""
    some = F.slice(entries, 1, MOST_ENTRIES)
    signed = doc["author_key"].isNotNull() & doc["sig"].isNotNull()
    attest = F.when(signed, F.concat(F.lit(b"\x01"), fixed_width(doc["author_key"], 32), fixed_width(doc["sig"], 64))).otherwise(F.lit(b"\x00"))
    one = lambda e: F.hex(F.concat(
        unsigned(e["doc_id"], 4), unsigned(e["seq"], 2), unsigned(e["version"], 2), unsigned(F.least(F.lit(65535), e["bytes"]), 2), unsigned(e["origin_id"], 4), unsigned(e["hits"], 4),
        capped_utf8(e["section"], SECTION), capped_utf8(e["snippet"], SNIPPET), float32(e["scale"]), unsigned(F.size(e["q"]), 2), int8_bytes(e["q"]), _holders(e["holders"]),
    ))
    head = F.concat(
        unsigned(doc["doc_key"], 4), capped_utf8(doc["title"], TITLE), capped_utf8(doc["source"], TITLE), unsigned(doc["bytes"], 4), unsigned(doc["chunk_count"], 2), unsigned(doc["origin_id"], 4),
        unsigned(doc["created_s"], 4), fixed_width(F.coalesce(doc["doc_hash"], F.lit(b"")), 32), attest, unsigned(F.size(some), 1),
    )
    return F.concat(head, F.unhex(F.array_join(F.transform(some, one), "")))


def identity_request(nonce: Column) -> Column:
    return fixed_width(nonce, 16)


def identity_reply(key: Column, name: Column, nonce: Column, sig: Column) -> Column:
    return F.concat(fixed_width(key, 32), capped_utf8(name, NAME), fixed_width(nonce, 16), fixed_width(sig, 64))


def read_identity_reply(b: Column) -> Column:
    at = after_text(b, 32)
    return F.struct(F.substring(b, F.lit(1), F.lit(32)).alias("key"), text_at(b, 32).alias("name"), F.substring(b, at + 1, F.lit(16)).alias("nonce"), F.substring(b, at + 17, F.lit(64)).alias("sig"))
