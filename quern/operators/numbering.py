"""Consecutive numbers in an order, without a task that sees all rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.sources.shared import written

#: Up to so many (partition, group) pairs are broadcast, each under 100 bytes and its group's value; more are joined by sorting.
FEW = 200_000
#: monotonically_increasing_id holds a row's place in its partition in so many bits.
PLACE = 33


def numbered(df: DataFrame, group: list[Column | str], order: list[Column | str], name: str = "id", first: int = 1) -> DataFrame:
    """df with `name`: 1, 2, 3 ... (from `first` on) within each group in the order given, ascending with nulls first.

    Rows are dealt by ranges of (group, order), so one group may fill many partitions, and written once in that order. A row's place in the
    whole is its place in its partition and the rows of all partitions before (one number for each partition goes to the driver); its number is
    that place less its group's first. A null group is a group of its own. Rows that agree in group and order get different numbers in any
    order; name all that tells them apart, or they meet in one partition. An empty table gives an empty result. Columns may have any names
    but the reserved _group_*, _at, _part and _first.
    """
    spark, keys = df.sparkSession, [f"_group_{i}" for i in range(len(group))]
    own = df.select("*", *[(F.col(g) if isinstance(g, str) else g).alias(k) for g, k in zip(group, keys)])
    dealt = own.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = written(dealt.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("_at", PLACE), F.col("_at").bitwiseAND((1 << PLACE) - 1)
    blocks = written(placed.groupBy(part.alias("_part"), *keys).agg(F.min(place).alias("_from"), F.count("*").alias("_n")), "numbered")
    before, total = [], 0
    for r in blocks.groupBy("_part").agg(F.sum("_n").alias("n")).orderBy("_part").collect():  # a row for each partition
        before.append((r["_part"], total))
        total += r["n"]
    offsets = F.broadcast(spark.createDataFrame(before, "_part long, _before long"))
    starts = blocks.join(offsets, "_part").select("_part", *keys, "_before", (F.col("_before") + F.col("_from")).alias("_start"))
    lows = starts.groupBy(*keys).agg(F.min("_start").alias("_low"))
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    lows = lows.select(*[F.col(k).alias(f"{k}_l") for k in keys], "_low")
    known = starts.join(lows, [F.col(k).eqNullSafe(F.col(f"{k}_l")) for k in keys] or F.lit(True)).select("_part", *keys, (F.col("_before") - F.col("_low")).alias("_first"))
    if blocks.count() <= FEW:
        known = F.broadcast(known)
    rows = placed.withColumn("_part", part)
    joined = rows.join(known, [rows["_part"] == known["_part"], *same(rows, known)])
    return joined.select(*[rows[f"`{c}`"] for c in df.columns], (place + F.col("_first") + first).alias(name))
