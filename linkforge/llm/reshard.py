"""Resharding at the least cost: a flow from old shards to new ones that moves the fewest bytes.

Old shards supply their bytes, new shards take bytes up to their capacity, and a byte costs
nothing where it stays and one where it moves. The cheapest flow says how much each old shard
gives to each new one. Each old shard's rows lie in blocks (by a hash of the key); running
sums over block totals, then over the rows of a block, give each row its place in bytes, and
the flow cuts that line into runs: first what stays, then what goes to each new shard. A
row belongs to the run in which it begins. Only rows of shards that give or take anything are
written again.

Nulls: a null text has no bytes. Rows with a null key are dealt to blocks by their text. Rows repeated whole are rows like any
other, and so are rows that tie in key, size and text: any order among them is right. Columns size, old_shard, shard and slot
are set anew; all others are kept, whatever their names, since they travel as one struct.
"""

from __future__ import annotations

import json
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkforge.llm.text import fresh
from linkforge.session import settled

#: Columns that are set anew.
SET = ("size", "old_shard", "shard", "slot")
#: Bytes that a row costs besides its text.
ROW_BYTES = 16


def min_cost_flow(supply: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """{(old, new): bytes} of a cheapest flow; staying costs 0, moving 1.

    Supplies must not exceed the capacities together. Old and new shards of one number are one place. Successive shortest
    paths come in two phases: first those of cost 0, which are old shard, same new shard; then those of cost 1. In between no path gets cheaper
    by taking back what stays, since that frees a place at the price of another move. In the second phase all paths cost the same,
    so a sweep over what is left of both sides fills them; time is linear in the shards.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities hold less than the supplies")
    flow = {}
    left, room = list(supply), list(capacity)
    for i in range(min(len(left), len(room))):
        stays = min(left[i], room[i])
        left[i] -= stays
        room[i] -= stays
        if stays:
            flow[i, i] = stays
    j = 0
    for i, give in enumerate(left):
        while give:
            while not room[j]:
                j += 1
            push = min(give, room[j])
            flow[i, j] = flow.get((i, j), 0) + push
            give -= push
            room[j] -= push
    return flow


def text_size(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def plan(rows: DataFrame, shards: int, weight: str, old: str, old_shards: int, blocks: int) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """(block table with its lead, flow). rows: old shard, block number and weight; blocks are a fixed number a shard."""
    totals = rows.groupBy(old, "_block").agg(F.sum(weight).alias("block_bytes"))
    totals = settled(totals, "blocks")
    supply = [0] * old_shards
    for r in totals.groupBy(old).agg(F.sum("block_bytes").alias("s")).collect():  # one row a shard
        supply[r[0]] = int(r["s"])
    whole = sum(supply)
    capacity = [whole * (j + 1) // shards - whole * j // shards for j in range(shards)]
    lead = F.coalesce(F.sum("block_bytes").over(Window.partitionBy(old).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return totals.withColumn("_lead", lead).select(old, "_block", "_lead"), min_cost_flow(supply, capacity)


def cuts(flow: dict[tuple[int, int], int]) -> list[tuple[int, int, int]]:
    """(old, first byte, new): where each run of an old shard's bytes begins; what stays comes first."""
    out, at = [], defaultdict(int)
    for (i, j), amount in sorted(flow.items(), key=lambda x: (x[0][0], x[0][0] != x[0][1], x[0][1])):
        out.append((i, at[i], j))
        at[i] += amount
    return out


def reshard(df: DataFrame, shards: int, old: Column, old_shards: int, key: str = "doc_id", text: str = "text", blocks: int | None = None) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """(row, a struct of df's columns, with size, old_shard, shard, and what with_slots() makes slots of; the flow that gave them).

    old: each row's shard before, 0 to old_shards - 1. Sizes of the new shards are equal but for
    the row that crosses each cut. slot counts a shard's rows from 0 without gaps. blocks: blocks
    an old shard, by default as many as four for each shuffle partition and shard at least, so
    that a block stays a small part of a task.
    """
    spark = df.sparkSession
    if blocks is None:
        blocks = max(16, -(-8 * int(spark.conf.get("spark.sql.shuffle.partitions")) // old_shards))
    tag = F.pmod(F.xxhash64(F.lit(7), F.coalesce(F.col(key).cast("string"), F.concat(F.lit("null:"), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)))), F.lit(blocks)).cast("int")
    kept = [c for c in df.columns if c.lower() not in SET or c in (key, text)]
    sized = df.select(F.struct(*kept).alias("row"), F.col(key).alias("_key"), F.crc32(F.col(text).cast("binary")).alias("_crc"), text_size(text).alias("size"), old.cast("int").alias("old_shard"), tag.alias("_block"))
    leads, flow = plan(sized.select("old_shard", "_block", "size"), shards, "size", "old_shard", old_shards, blocks)
    # A fixed number of blocks: old_shards * blocks rows, whatever the input's size.
    placed = sized.join(F.broadcast(leads), ["old_shard", "_block"])
    order = Window.partitionBy("old_shard", "_block").orderBy("_key", "size", "_crc")
    begin = F.col("_lead") + F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    where = F.lit(None).cast("int")
    by_old = defaultdict(list)
    for i, first, j in cuts(flow):
        by_old[i].append((first, j))
    arrays = F.map_from_arrays(F.array(*[F.lit(i) for i in by_old]), F.array(*[F.array(*[F.struct(F.lit(a).cast("long").alias("at"), F.lit(j).alias("to")) for a, j in runs]) for runs in by_old.values()])) if by_old else None
    if arrays is not None:
        where = F.element_at(F.filter(arrays[F.col("old_shard")], lambda c: c["at"] <= F.col("_begin")), -1)["to"]
    placed = placed.withColumn("_begin", begin).withColumn("shard", where)
    runs = Window.partitionBy("old_shard", "_block", "shard").orderBy("_begin")
    placed = placed.withColumn("_rank", F.row_number().over(runs))
    return placed.drop("_lead", "_begin", "_key", "_crc"), flow


def with_slots(placed: DataFrame) -> DataFrame:
    """df's columns with size, old_shard, shard and slot: a row's number in its new shard, from the counts of the blocks before its own."""
    counts = placed.groupBy("shard", "old_shard", "_block").agg(F.max("_rank").alias("n"))
    first = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("old_shard", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = settled(counts.withColumn("_first", first).select("shard", "old_shard", "_block", "_first"), "slots")
    return placed.join(F.broadcast(starts), ["shard", "old_shard", "_block"]).withColumn("slot", (F.col("_first") + F.col("_rank") - 1).cast("long")).select("row.*", "size", "old_shard", "shard", "slot")


def affected(flow: dict[tuple[int, int], int]) -> set[int]:
    """Shards whose files change: those that give or take bytes."""
    return {k for (i, j) in flow if i != j for k in (i, j)}


def write_shards(placed: DataFrame, path: str) -> None:
    """A directory shard=N for each shard, written by Spark's committer."""
    placed.write.partitionBy("shard").parquet(path)


def rewrite(spark: SparkSession, layout: dict[int, str], shards: int, new_path: str, key: str = "doc_id", text: str = "text") -> tuple[dict[int, str], dict[tuple[int, int], int]]:
    """({shard: directory}, flow): the layout after resharding to the given number of shards of equal bytes.

    layout: {shard: directory of its Parquet files}. Only the shards that give or take rows are read
    whole and written again, under new_path; the others keep their directories. Sizes come from
    the key and text columns alone.
    """
    old_shards = max(layout) + 1
    parts = [spark.read.parquet(d) for _, d in sorted(layout.items())]
    mark = fresh("old", parts[0].columns)
    rows = reduce(DataFrame.unionByName, (p.withColumn(mark, F.lit(i)) for p, i in zip(parts, sorted(layout))))
    placed, flow = reshard(rows, shards, F.col(mark), old_shards, key, text)
    touched = affected(flow) | {i for i in layout if i >= shards}
    if touched:
        moved = placed.where(F.col("old_shard").isin(sorted(touched & set(layout))))
        moved.select("row.*", "shard").drop(mark).write.partitionBy("shard").parquet(new_path)
    new = {j: (f"{new_path}/shard={j}" if j in touched else layout[j]) for j in range(shards) if any(b == j for _, b in flow)}
    return new, flow


def manifest(layout: dict[int, str]) -> str:
    return json.dumps({str(k): v for k, v in sorted(layout.items())})
