"""Joins and windows that keep one heavy key from landing in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
HOT_KEYS = 1_000
HUB_ROWS = 10_000
SIFT_BITS = 1 << 24


def split_lookup(big: DataFrame, small: DataFrame, keys: list[str], count_col: str,
                 hot_rows: int = HOT_ROWS, how: str = "inner") -> DataFrame:
    """Join ``big`` to one ``small`` row per key, whatever the key frequencies are.

    ``count_col`` holds how many ``big`` rows carry the key.  The ``HOT_KEYS``
    heaviest keys, a fixed number, are broadcast; any other key has less than
    1 / HOT_KEYS of the rows, and these shuffle evenly.
    """
    hot = small.filter(F.col(count_col) > hot_rows).orderBy(F.desc(count_col), *keys).limit(HOT_KEYS)
    marked = F.broadcast(hot.select(*keys, F.lit(True).alias("_hot")))
    cold = small.join(marked, keys, "left_anti")
    tagged = big.join(marked, keys, "left")
    on_hot = tagged.filter("_hot").drop("_hot").join(F.broadcast(hot), keys, how)
    return on_hot.unionByName(tagged.filter("_hot IS NULL").drop("_hot").join(cold, keys, how))


def hub_lookup(rows: DataFrame, key: str, table: DataFrame, total: int, hub_rows: int = HUB_ROWS) -> DataFrame:
    """Left join of ``rows`` to ``table``, which has one row per ``key`` at most, that no hub can pile up in one task.

    A hub is a key with more than ``hub_rows`` of the at most ``total`` rows and more than a 1 / (2 x partitions) share of them, so
    there are at most 2 x partitions hubs: their few table rows are broadcast and their rows stay where they are.  Only the
    other rows are shuffled by key.  Without enough rows for any hub there is nothing to part.  The table itself is never broadcast: a
    compressed table under Spark's threshold is many times larger in memory, and a loop would send one through the driver per pass.
    """
    limit = max(hub_rows, total // (2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    if total <= limit:
        return rows.join(table.hint("merge"), key, "left")
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    hubs = F.broadcast(counts.drop("_n").join(table.hint("merge"), key, "left").withColumn("_hub", F.lit(True)))
    marked = rows.join(hubs, key, "left")
    others = marked.filter("_hub IS NULL").select(rows.columns).join(table.hint("merge"), key, "left")
    return marked.filter("_hub").drop("_hub").unionByName(others)


def marked(rows: DataFrame, keys: list[Column], listed: DataFrame, listed_keys: list[Column], name: str = "_maybe", bits: int = SIFT_BITS) -> DataFrame:
    """``rows`` with ``name``: False only if no row of ``listed`` has the keys, so rows surely not listed need no shuffle.

    One hash per key sets one of ``bits`` bits, a number that does not grow with the input; the bitmaps of 32,768 bits each are
    broadcast.  With more keys more rows are marked in vain; callers decide marked rows by an exact join.
    """
    place = lambda cols: F.pmod(F.xxhash64(*cols), F.lit(bits)) + 1
    maps = listed.select(place(listed_keys).alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_map"))
    at = F.bitmap_bit_position(place(keys))
    byte = F.conv(F.hex(F.substring("_map", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (at % 8).cast("int"))) != 0, F.lit(False))
    found = rows.withColumn("_bucket", F.bitmap_bucket_number(place(keys))).join(F.broadcast(maps), "_bucket", "left")
    return found.select(*rows.columns, hit.alias(name))


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], salts: int = 16,
                how: str = "inner") -> DataFrame:
    """Spread each key of ``big`` over ``salts`` partitions; ``small`` is repeated per salt."""
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def _prior_buckets(df: DataFrame, keys: list[str], bucket: str, aggs: list[Column]) -> DataFrame:
    """Per (key, bucket) aggregates; the bucket rows are few even for a hot key."""
    return df.groupBy(*keys, bucket).agg(*aggs)


def running_sums(df: DataFrame, keys: list[str], bucket: str, order: list[Column],
                 values: dict[str, Column]) -> DataFrame:
    """Inclusive running sums per key, computed bucket by bucket.

    ``bucket`` is a coarse column that agrees with the order (a day, a block of
    a sequence).  Bucket totals are summed first, then each bucket adds its own
    rows, so no window ever spans all rows of one key.
    """
    marked = df.withColumns({f"_v_{n}": v for n, v in values.items()})
    totals = _prior_buckets(marked, keys, bucket, [F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    before = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    base = totals.select(*keys, bucket, *[
        F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in values])
    inside = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = marked.withColumns({f"_i_{n}": F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in values})
    out = out.join(base, [*keys, bucket])
    return out.withColumns({n: F.col(f"_i_{n}") + F.col(f"_b_{n}") for n in values}).drop(
        *[f"{p}{n}" for n in values for p in ("_v_", "_i_", "_b_")])


def lagged(df: DataFrame, keys: list[str], bucket: str, order: Column, value: Column, name: str) -> DataFrame:
    """Previous row's value per key; the first row of a bucket looks at the bucket before."""
    marked = df.withColumns({"_o": order, "_v": value})
    last = _prior_buckets(marked, keys, bucket, [F.max_by(F.struct("_v"), F.col("_o")).alias("_last")])
    previous = last.select(*keys, bucket, F.lag("_last").over(
        W.partitionBy(*keys).orderBy(bucket)).alias("_prev"))
    inside = W.partitionBy(*keys, bucket).orderBy("_o")
    out = marked.withColumn("_in", F.lag(F.struct("_v")).over(inside)).join(previous, [*keys, bucket])
    return out.withColumn(name, F.coalesce(F.col("_in"), F.col("_prev"))["_v"]).drop("_o", "_v", "_in", "_prev")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key; Spark cuts each map-side partition to ``k`` before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)
