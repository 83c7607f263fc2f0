"""Replicated state as merges of append-only logs: counters, claims with expiry, last writer wins, upserts and deletes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counter_shares(log: DataFrame, key: str, node: str, hits: str = "hits") -> DataFrame:
    """A grow-only counter's shares: each node's highest count of a key."""
    return log.groupBy(key, node).agg(F.max(hits).alias("hits"))


def counter_values(shares: DataFrame, key: str) -> DataFrame:
    """The counter: the sum of its shares."""
    return shares.groupBy(key).agg(F.sum("hits").alias("hits"))


def incremented(log: DataFrame, key: str, node: str) -> DataFrame:
    """Shares from single accesses: one row, one hit."""
    return log.groupBy(key, node).agg(F.count(F.lit(1)).alias("hits"))


def live_claims(log: DataFrame, key: str, node: str, seen: str, now: Column, ttl_seconds: int, self_id: Column | None = None) -> DataFrame:
    """(key, node, seen): the latest claim of each node, where it is younger than its time to live; a node's own doesn't expire."""
    last = log.groupBy(key, node).agg(F.max(seen).alias(seen))
    fresh = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col(seen).cast("timestamp")) <= ttl_seconds
    return last.where(fresh if self_id is None else fresh | (F.col(node) == self_id))


def holder_map(claims: DataFrame, held: DataFrame, key: str, node: str, self_id: int) -> DataFrame:
    """(key, holders): the nodes that claim a key, in order; for the node itself what it holds (held: key) counts, not its claims."""
    rows = claims.where(F.col(node) != self_id).select(key, node).unionByName(held.select(key, F.lit(self_id).cast("long").alias(node)))
    return rows.groupBy(key).agg(F.sort_array(F.collect_set(node)).alias("holders"))


def self_claims(claims: DataFrame, held: DataFrame, key: str, node: str, seen: str, now: Column, self_id: int) -> DataFrame:
    """claims with the node's own made anew: one of `now` for each key that it holds, none for others."""
    own = held.select(key, F.lit(self_id).cast("long").alias(node), now.alias(seen)).distinct()
    return claims.where(F.col(node) != self_id).unionByName(own)


def admitted_claims(claims: DataFrame, meta: DataFrame, key: str, node: str, self_id: int) -> DataFrame:
    """claims of keys that have a meta row, less those about the node itself, which alone knows what it holds."""
    return claims.where(F.col(node) != self_id).join(meta.select(key), key, "left_semi")


def claim_ttl_web(cycle_s: Column, floor: int = 60) -> Column:
    """The other build's rule: two announcement cycles."""
    return F.greatest(F.lit(floor), cycle_s * 2)


def claim_ttl_seconds(known: Column, floor: int = 90, batch: int = 24, cycle_s: int = 8, share: float = 0.5) -> Column:
    """How long a claim lives: long enough for two rounds of refreshing `known` of them."""
    return F.greatest(F.lit(float(floor)), F.ceil(known / batch) * cycle_s / share)


def newest(log: DataFrame, key: str, version: str, arrival: str) -> DataFrame:
    """The row of the highest version of each key; of equal versions the one that came first. A partial maximum is taken before
    rows travel."""
    rest = [c for c in log.columns if c != key]
    order = F.struct(F.col(version), -F.col(arrival).cast("long"))
    best = log.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return best.select(key, "_row.*").select(*log.columns)


def inserted_or_ignored(existing: DataFrame, new: DataFrame, key: str, *arrival: str) -> DataFrame:
    """existing plus the new rows of keys that it lacks; of several, the one that came first (by the columns `arrival`, which are none
    of existing)."""
    return existing.unionByName(first_lacking(existing, new, key, *arrival))


def first_lacking(existing: DataFrame, new: DataFrame, key: str, *arrival: str) -> DataFrame:
    """What inserted_or_ignored() adds to existing. A key whose rows have no arrival at all gets nulls."""
    rest = [c for c in existing.columns if c != key]
    order = F.when(F.col(arrival[0]).isNotNull(), F.struct(*arrival))
    first = new.join(existing, key, "left_anti").groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return first.select(key, "_row.*").select(*existing.columns)


def looked_up(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows whose key is among keys, each once however often a key is asked for."""
    return rows.join(keys.select(key), key, "left_semi")


def difference(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """rows whose key is not among the done ones; null keys are among none."""
    return rows.join(done.select(key), key, "left_anti")


def all_of(asked: DataFrame, done: DataFrame, group: str, member: str) -> DataFrame:
    """(group, all_done): whether each member that a group asks for is among its done ones."""
    rest = asked.join(done.select(group, member).distinct(), [group, member], "left_anti").groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    return asked.select(group).distinct().join(rest, group, "left").select(group, F.col("_n").isNull().alias("all_done"))


def tail_of(log: DataFrame, order: Column, most: int, *by: str) -> DataFrame:
    """The latest `most` rows of a log, of each group where `by` names one."""
    if not by:
        return log.orderBy(order.desc()).limit(most)
    return log.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order.desc()))).where(F.col("_n") <= most).drop("_n")


def fresh_since(log: DataFrame, seq: str, last: Column) -> DataFrame:
    """What came after the last sequence number that was read."""
    return log.where(F.col(seq) > last)


def rotated(rows: DataFrame, size: int, cursor: int, order: list[Column], by: list[str]) -> DataFrame:
    """rows with `batch`: `size` of a group at a time, as rows come round from the cursor on."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    rows = rows.withColumn("_p", place).join(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), by)
    return rows.withColumn("batch", F.floor(F.pmod(F.col("_p") - cursor, F.col("_n")) / size)).drop("_p", "_n")


def upserted(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """existing with the rows of new in place of those of equal keys."""
    return existing.join(new, key, "left_anti").select(*existing.columns).unionByName(new.select(*existing.columns))


def cascade_delete(keys: DataFrame, key: str, meta: DataFrame, parents: DataFrame, parent: str, *others: DataFrame) -> tuple[DataFrame, ...]:
    """(meta, parents, *others) without the keys; parents that have no meta row left go too."""
    left = meta.join(keys, key, "left_anti")
    return left, parents.join(left, parent, "left_semi"), *(o.join(keys, key, "left_anti") for o in others)


def with_missing_columns(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """df with the columns that it lacks."""
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})


def outbox_due(outbox: DataFrame, now: Column) -> DataFrame:
    """Unexpired messages in order for each destination, with their place in it."""
    order = F.row_number().over(Window.partitionBy("dst_id").orderBy("queued_at", "id"))
    return outbox.where(F.col("expires_at") >= now).withColumn("place", order)


def outbox_expired(outbox: DataFrame, now: Column) -> DataFrame:
    """What a purge of the outbox takes out."""
    return outbox.where(F.col("expires_at") < now)


def in_batches(df: DataFrame, size: int, order: list[Column], by: list[str]) -> DataFrame:
    """df with `batch`: rows of each group in order, `size` to a batch."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / size))


def catalog_page(docs: DataFrame, order: list[Column], count: str, most: int, by: list[str], since: Column | None = None, chunk: Column | None = None) -> DataFrame:
    """Whole documents in order until `most` entries are sent; the last may go beyond. since: which documents are asked for. chunk: a
    coarser order that the order goes within; then chunks are summed first, and rows of a chunk that begins beyond `most` never
    leave their task, so that a group of very many documents is no single task's."""
    docs = docs if since is None else docs.where(since)
    ends = (Window.unboundedPreceding, -1)
    if chunk is None:
        before = F.sum(count).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(*ends))
        return docs.withColumn("sent_before", F.coalesce(before, F.lit(0)).cast("long")).where(F.col("sent_before") < most)
    rows = docs.withColumn("_chunk", chunk)
    sums = rows.groupBy(*by, "_chunk").agg(F.sum(count).alias("_sum"))
    base = F.coalesce(F.sum("_sum").over(Window.partitionBy(*by).orderBy("_chunk").rowsBetween(*ends)), F.lit(0)).cast("long")
    starts = sums.select(*by, "_chunk", base.alias("_base")).where(F.col("_base") < most)
    starts = starts.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate([*by, "_chunk"])], "_base")
    same = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate([*by, "_chunk"])]
    own = F.coalesce(F.sum(count).over(Window.partitionBy(*by, "_chunk").orderBy(*order).rowsBetween(*ends)), F.lit(0))
    rows = rows.join(starts, reduce(Column.__and__, same)).withColumn("sent_before", (own + F.col("_base")).cast("long"))
    return rows.where(F.col("sent_before") < most).select(*docs.columns, "sent_before")
