"""Merges of entities with all that hangs on them, marks of distinct pairs, and undo by before-images.

Tables: entities (id, type, label, attrs, ids, geo, source_text), links (id, src, dst, type, ...), events (id, members, ...). A merge (seq, keep, drop) is one that a user
asked for as number seq: nothing happens if either has been absorbed before, or if both are one. A keep absorbs its drops in order: what it lacks is taken
from the first that has it, its aliases grow by their names, links move, loops and repeated links go, events follow.

Merges that hang together form trees. Each round merges the keeps all of whose drops are complete, so rounds grow with the depth of the trees, not with their number. Values
are taken by aggregation; only the alias and source texts of a keep, which hold all of its drops' texts anyway, are put together in one place.

Nulls in seq, keep or drop, and unknown ids, make a merge void. Equal requests count once. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkforge.session import release, settled

#: Steps that can be undone.
DEPTH = 50
ALIAS, BREAK = "aka", "\n---\n"


def valid_merges(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """(seq, keep, drop) of the merges that happen, settled."""
    ids = entities.select("id").where("id is not null").distinct()
    asked = merges.select("seq", "keep", "drop").where("seq is not null and keep <> drop").distinct()
    asked = asked.join(ids.withColumnRenamed("id", "keep"), "keep", "left_semi").join(ids.withColumnRenamed("id", "drop"), "drop", "left_semi")
    # A merge is judged when nothing earlier that could absorb its keep or drop is open.
    open_, known = settled(asked, "open"), None
    while open_.limit(1).count():
        gone = known.select(F.col("drop").alias("id"), F.col("seq").alias("at")) if known is not None else None
        left = open_
        if gone is not None:
            for side in ("keep", "drop"):
                left = left.join(gone.select(F.col("id").alias(side), "at"), side, "left").where("at is null or at > seq").drop("at")
        first = left.groupBy("drop").agg(F.min("seq").alias("at"))
        before = first.withColumnRenamed("drop", "keep").withColumnRenamed("at", "keep_at")
        judged = left.join(first, "drop").join(before, "keep", "left").withColumn("now", (F.col("seq") == F.col("at")) & (F.col("keep_at").isNull() | (F.col("keep_at") > F.col("seq"))))
        judged = settled(judged.select("seq", "keep", "drop", "now"), "judged")
        new = judged.where("now").select("seq", "keep", "drop")
        held = settled(new if known is None else known.unionByName(new), "known")
        rest = settled(judged.where("not now").select("seq", "keep", "drop").join(new.select("drop").distinct(), "drop", "left_anti"), "open")
        release(open_, judged, *([known] if known is not None else []))
        open_, known = rest, held
    return known if known is not None else open_


def _absorbed(held: DataFrame, now: DataFrame) -> DataFrame:
    """held entities after the merges of now, whose drops absorb nothing more."""
    parts = now.join(held.withColumnRenamed("id", "drop"), "drop")
    keeps = held.join(now.select(F.col("keep").alias("id")).distinct(), "id", "left_semi")
    rows = keeps.select("id", F.lit(-1).cast("long").alias("nth"), "attrs", "ids", "geo").unionByName(parts.select(F.col("keep").alias("id"), F.col("seq").cast("long").alias("nth"), "attrs", "ids", "geo"))

    def union(name: str, some: str) -> DataFrame:
        tall = rows.select("id", "nth", F.explode(name).alias("k", "v")).where(some)
        first = tall.groupBy("id", "k").agg(F.min_by("v", "nth").alias("v"))
        return first.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias(name))

    geo = rows.where("geo is not null").groupBy("id").agg(F.min_by("geo", "nth").alias("geo"))
    told = parts.groupBy(F.col("keep").alias("id")).agg(F.sort_array(F.collect_list(F.struct("seq", "label", "source_text"))).alias("drops"))
    texts = F.aggregate("drops", F.coalesce("source_text", F.lit("")), lambda acc, d: F.when(F.coalesce(d["source_text"], F.lit("")) == "", acc).when(F.contains(acc, d["source_text"]), acc).when(acc == "", d["source_text"]).otherwise(F.concat(acc, F.lit(BREAK), d["source_text"])))
    empty = F.expr("cast(map() as map<string,string>)")
    # Aliases: the first known ones of the keep and its drops as they come, each drop's name behind what was known by then.
    akas = parts.groupBy(F.col("keep").alias("id")).agg(F.sort_array(F.collect_list(F.struct("seq", F.col("attrs")[ALIAS].alias("aka"), "label"))).alias("names"))
    aka = F.aggregate("names", F.col("own"), lambda acc, d: F.when(d["label"].eqNullSafe(F.col("label")), F.coalesce(acc, d["aka"])).otherwise(F.concat_ws("; ", F.coalesce(acc, d["aka"]), d["label"])))
    base = keeps.select("id", "type", "label", F.col("attrs")[ALIAS].alias("own"), F.col("source_text"))
    out = base.join(union("attrs", f"k <> '{ALIAS}'"), "id", "left").join(union("ids", "v is not null and v <> ''"), "id", "left").join(geo, "id", "left").join(told, "id").join(akas, "id")
    out = out.withColumn("own", F.nullif(aka, F.lit(""))).withColumn("attrs", F.coalesce("attrs", empty))
    out = out.select("id", "type", "label", F.when(F.col("own").isNull(), F.col("attrs")).otherwise(F.map_concat("attrs", F.map_from_arrays(F.array(F.lit(ALIAS)), F.array("own")))).alias("attrs"), F.coalesce("ids", empty).alias("ids"), "geo", texts.alias("source_text"))
    moved = now.select(F.col("keep").alias("id")).unionByName(now.select(F.col("drop").alias("id"))).distinct()
    return held.join(moved, "id", "left_anti").select(*out.columns).unionByName(out)


def merge(entities: DataFrame, links: DataFrame, events: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, links, events) after the merges; other columns of links and events stay, those of entities must be the ones named above."""
    kept = ["id", "type", "label", "attrs", "ids", "geo", "source_text"]
    todo = valid_merges(entities, merges)
    held = entities.select(*kept).where("id is not null")
    to = settled(todo.select(F.col("drop").alias("id"), F.col("keep").alias("root")), "roots")
    pending = todo
    while pending.limit(1).count():
        busy = pending.join(pending.select(F.col("keep").alias("drop")).distinct(), "drop", "left_semi").select("keep").distinct()
        now = settled(pending.join(busy, "keep", "left_anti"), "now")
        held = settled(_absorbed(held, now), "held")
        pending = settled(pending.join(now.select("drop"), "drop", "left_anti"), "pending")
    roots = closed(to)

    def root_of(df: DataFrame, column: str) -> DataFrame:
        found = roots.select(F.col("id").alias(column), "root")
        return df.join(found, column, "left").withColumn(column, F.coalesce("root", column)).drop("root")

    moved = root_of(root_of(links, "src"), "dst").where("src <> dst")
    first = Window.partitionBy("src", "dst", "type").orderBy("id")
    links_ = moved.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth").select(*links.columns)
    members = events.select("id", F.posexplode("members").alias("pos", "member"))
    named = root_of(members, "member").groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "member"))), lambda x: x["member"]).alias("_members"))
    events_ = events.join(named, "id", "left").withColumn("members", F.coalesce("_members", "members")).select(*events.columns)
    return held, links_, events_


def closed(pairs: DataFrame) -> DataFrame:
    """(id, root), settled: the end of each chain of (id, root), an id having one root; chains halve from round to round."""
    now = settled(pairs, "chains")
    while True:
        ahead = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        joined = settled(now.join(ahead, "root", "left").select("id", "root", "next"), "joined")
        if not joined.where("next is not null").limit(1).count():
            out = settled(joined.select("id", "root"), "chains")
            release(now, joined)
            return out
        before, now = now, settled(joined.select("id", F.coalesce("next", "root").alias("root")), "chains")
        release(before, joined)


def images(before: DataFrame, after: DataFrame, step: int, key: str = "id") -> DataFrame:
    """(step, key, before): what a step changed, by its state before it; before is null for a row that the step made."""
    old = before.select(F.col(key).alias("key"), F.struct(*before.columns).alias("before"))
    new = after.select(F.col(key).alias("key"), F.struct(*before.columns).alias("after"))
    # Maps have no order and can't be compared; their JSON, by sorted entries, can.
    same = lambda c: F.to_json(F.struct(*[F.to_json(F.sort_array(F.map_entries(c[f.name]))).alias(f.name) if f.dataType.typeName() == "map" else c[f.name].alias(f.name) for f in before.schema.fields]))
    both = old.join(new, "key", "full")
    differs = ~same(F.col("before")).eqNullSafe(same(F.col("after"))) | F.col("before").isNull() | F.col("after").isNull()
    return both.where(differs).select(F.lit(step).alias("step"), "key", "before")


def undo(now: DataFrame, log: DataFrame, steps: int = 1, key: str = "id", depth: int = DEPTH) -> DataFrame:
    """now without what the last steps of the log changed, DEPTH at most: each row's state before the first of them, in one pass."""
    last = log.agg(F.max("step").alias("last"))
    some = log.join(F.broadcast(last)).where(F.col("step") > F.col("last") - min(steps, depth)).drop("last")  # one row
    first = some.groupBy("key").agg(F.min_by(F.struct("before"), "step").alias("m")).select("key", "m.before")
    kept = now.join(first.select(F.col("key").alias(key)), key, "left_anti").select(*now.columns)
    return kept.unionByName(first.where("before is not null").select("before.*").select(*now.columns))
