"""Document hashes, signed manifests' bytes, fingerprints, safety numbers and trust decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftglass.functions.codec import capped_utf8, fixed_width, unsigned

CONTENT_TAG, MANIFEST_TAG = "driftglass-doc-v1\n", "driftglass-manifest-v1\n"


def document_hash(title: Column, body: Column) -> Column:
    """SHA-256 (hex) of a tag, the title and the passages joined by line ends."""
    return F.sha2(F.concat(F.lit(CONTENT_TAG), title, F.lit("\n"), body), 256)


def manifest_bytes(doc_key: Column, author: Column, chunks: Column, size: Column, created_s: Column, title: Column, source: Column, doc_hash_hex: Column) -> Column:
    """What an author signs: a tag, five numbers of four bytes, title and source with their lengths, the document's hash."""
    text = lambda s: F.concat(unsigned(F.octet_length(s), 2), F.encode(s, "UTF-8"))
    return F.concat(F.encode(F.lit(MANIFEST_TAG), "UTF-8"), *[unsigned(n, 4) for n in (doc_key, author, chunks, size, created_s)], text(title), text(source), F.unhex(doc_hash_hex))


def fingerprint(key: Column) -> Column:
    """The first eight bytes of a key's SHA-256 as four groups of upper-case hex."""
    return F.trim(F.regexp_replace(F.upper(F.substring(F.sha2(key, 256), 1, 16)), "(.{4})", "$1 "))


def icons(digest_hex: Column, n: int) -> Column:
    """Five bits of each of the first n bytes: indexes into a list of 32 icons."""
    return F.array(*[(F.conv(F.substring(digest_hex, 2 * i + 1, 2), 16, 10).cast("int") % 32) for i in range(n)])


def pair_digest(a: Column, b: Column) -> Column:
    """SHA-256 of two keys, the smaller first, so both sides get the same."""
    a_first = F.hex(a) <= F.hex(b)
    return F.sha2(F.when(a_first, F.concat(a, b)).otherwise(F.concat(b, a)), 256)


def safety_number(a: Column, b: Column) -> Column:
    """Six groups of five digits, each from three bytes of the pair's digest."""
    d = pair_digest(a, b)
    return F.concat_ws(" ", *[F.lpad((F.conv(F.substring(d, 6 * g + 1, 6), 16, 10).cast("long") % 100000).cast("string"), 5, "0") for g in range(6)])


def authorship(key: Column, sig: Column, key_id: Column, author: Column, signature_ok: Column) -> Column:
    """unsigned, verified or forged. Half an attestation is forged, as is a key that is not the author's."""
    has_key, has_sig = F.octet_length(F.coalesce(key, F.lit(b""))) > 0, F.octet_length(F.coalesce(sig, F.lit(b""))) > 0
    return F.when(~has_key & ~has_sig, "unsigned").when(has_key & has_sig & (key_id == author) & F.coalesce(signature_ok, F.lit(False)), "verified").otherwise("forged")


def content_intact(stored_hash: Column, actual_hash: Column, held: Column, chunks: Column) -> Column:
    """Whether what is held hashes to what was signed; null where not all is held."""
    return F.when(held == chunks, stored_hash == actual_hash)


def judged(asked: Column, nonce_ok: Column, id_ok: Column, signature_ok: Column, known_key: Column, key: Column, trusted: Column) -> Column:
    """A challenge's outcome: unsolicited, wrong-nonce, wrong-id, bad-signature, key-changed, trusted or verified, in this order."""
    return (
        F.when(~asked, "unsolicited").when(~nonce_ok, "wrong-nonce").when(~id_ok, "wrong-id").when(~signature_ok, "bad-signature")
        .when(known_key.isNotNull() & (known_key != key), "key-changed").when(trusted, "trusted").otherwise("verified")
    )


def shown_name(verified_at: Column, signed: Column, beaconed: Column) -> Column:
    return F.when(verified_at > 0, signed).otherwise(beaconed)


def challenge_bytes(nonce: Column, node_id: Column, name: Column) -> Column:
    """What an answer to a challenge signs: the nonce (16 bytes), the node's id and its name (32 bytes at most)."""
    return F.concat(fixed_width(nonce, 16), unsigned(node_id, 4), capped_utf8(name, 32))


def confirmed(state: Column) -> Column:
    """A peer's state once its safety number was compared in person: only a proven key becomes trusted."""
    return F.when(state == "verified", "trusted").otherwise(state)


def revoked(verified_at: Column) -> Column:
    """A peer's state once trust is taken back."""
    return F.when(F.coalesce(verified_at, F.lit(0)) > 0, "verified").otherwise("unknown")
