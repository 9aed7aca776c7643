"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix.

A uniform random permutation of N rows, cut into shards of given sizes, sends from each source partition to each shard
a number of rows that follows the multivariate hypergeometric law.  These numbers are drawn first (one row per
partition, one column per shard; rows add up to the partitions' sizes, columns to the shards').  Then each partition
permutes its rows locally and deals them out by the drawn numbers, the rows are exchanged once, and every shard
permutes what it received.  The last permutation is a sort by a random hash in blocks of that hash, so that no shard
is one task.  Rows pass through DataFrame operations only; the driver handles the matrix.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinprofile.llm.common import materialise, without


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> list[list[int]]:
    """Exact counts from each partition to each shard, as a uniform permutation would have them."""
    rng, left = np.random.default_rng(seed), np.array(columns, np.int64)
    out = []
    for n in rows:
        drawn, total, need = [], int(left.sum()), n
        for k in range(len(left)):  # one cell after the other; numpy's own draw of a cell takes any size below 1e9
            total -= int(left[k])
            take = _hypergeometric(rng, int(left[k]), total, need)
            drawn.append(take)
            need -= take
        left -= drawn
        out.append(drawn)
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Number of good ones among ``n`` drawn from ``good + bad``."""
    if not n or not good:
        return 0
    if not bad:
        return n
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    # Beyond numpy's limit: inversion outwards from the mode, in about as many steps as the standard deviation.
    low, high = max(0, n - bad), min(n, good)
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    pick = lambda total, k: math.lgamma(total + 1) - math.lgamma(k + 1) - math.lgamma(total - k + 1)
    up = down = math.exp(pick(good, mode) + pick(bad, n - mode) - pick(good + bad, n))
    left, above, below = rng.random() - up, mode, mode
    while left > 0 and (above < high or below > low):
        if above < high:
            up *= (good - above) * (n - above) / ((above + 1) * (bad - n + above + 1))
            above += 1
            left -= up
            if left <= 0:
                return above
        if below > low:
            down *= below * (bad - n + below) / ((good - below + 1) * (n - below + 1))
            below -= 1
            left -= down
            if left <= 0:
                return below
    return mode


def _random(seed: int, *parts: str) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(p) for p in parts])


def shuffle_into_shards(
    df: DataFrame, shards: int, seed: int = 17, rows_per_task: int = 500_000, shard: str = "shard", slot: str = "slot"
) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1, counts at most one apart) and ``slot`` (gapless from 0 in each shard).

    All columns are carried along, except those called like the two new ones, which are replaced.  Null values, repeated
    rows and an empty table need no special case: rows are told apart by their place in the table.  The input is written
    once with that place, so a lost executor repeats no draw; later steps read the same rows in the same order.
    """
    spark = df.sparkSession
    kept = without(df, [shard, slot, "_part", "_rank", "_order", "_block"])
    # Local permutation: within each source partition, order by a hash of the row's place there.
    placed = kept.withColumn("_order", F.xxhash64(F.lit(seed), F.monotonically_increasing_id()))
    mixed = placed.sortWithinPartitions("_order").withColumn("_rank", F.monotonically_increasing_id())
    low = (1 << 33) - 1
    mixed = mixed.withColumn("_part", F.shiftright("_rank", 33)).withColumn("_rank", F.col("_rank").bitwiseAND(F.lit(low)))
    written = materialise(mixed.drop("_order"), "sources")
    sizes = {r["_part"]: r["count"] for r in written.groupBy("_part").count().collect()}  # one number per source partition
    parts, total = sorted(sizes), sum(sizes.values())
    columns = [total // shards + (k < total % shards) for k in range(shards)]
    matrix = communication_matrix([sizes[p] for p in parts], columns, seed)
    cuts = [(p, np.cumsum(row)[:-1].tolist()) for p, row in zip(parts, matrix)]
    drawn = spark.createDataFrame(cuts, "_part long, _cuts array<long>")
    dealt = written.join(drawn, "_part").withColumn(
        shard, F.size(F.filter("_cuts", lambda c: c <= F.col("_rank"))).cast("int")
    )
    # The second permutation: blocks are dealt by some bits of a random hash and sorted by all of them.
    blocks = max(1, math.ceil(total / shards / rows_per_task))
    order = dealt.withColumn("_order", _random(seed + 1, "_part", "_rank")).drop("_cuts")
    block = F.pmod(F.shiftrightunsigned("_order", 33), F.lit(blocks)).cast("int")
    order = order.withColumn("_block", block)
    own = Window.partitionBy(shard, "_block").orderBy("_order", "_part", "_rank")
    ranked = order.withColumn("_in", F.row_number().over(own) - 1)
    out = [*kept.columns, shard, slot]
    if blocks == 1:
        return ranked.withColumn(slot, F.col("_in").cast("long")).select(out)
    before = Window.partitionBy(shard).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counted = order.groupBy(shard, "_block").count()  # shards x blocks rows
    first = counted.withColumn("_first", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    return ranked.join(first, [shard, "_block"]).withColumn(slot, F.col("_first") + F.col("_in")).select(out)
