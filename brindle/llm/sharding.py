"""Sharding by balanced label propagation.

Documents with equal texts are linked. Law `rows`: shards' counts differ by one at most. Every document starts with a shard by
hash. In each round the linked documents that haven't settled look at their neighbours' shards (a Spark join of groups with
counts by shard) and all of a group move to the shard where most of them are (of several, to one by hash), among shards with room, as far as the
shard's quota allows; large groups move first, and rounds go on until no shard has room for a group that waits. A group that is larger than a shard is first cut into parts as large as a shard, which is
as few parts as can be. Documents without links then fill the shards exactly, so an edge is cut only where quotas force it.

The driver holds one number for each shard. Groups meet only as counts; ranks are running counts over hash buckets, so a text
that a third of all documents share is dealt out like any other.

Nulls: a null text counts as empty (size 8), so such documents are linked with empty ones; a null id is carried. Repeated rows
are documents of their own. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import chain, repeat

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import BROADCAST_WIDE_ROWS, buckets_for, cut, running, spread_join, table

SHARDS = 24
#: A round takes groups of at least this share of a shard; the last ones take all that is left, and are repeated while any is taken.
ROUNDS = (2, 4, 8, 32, 128, 0, 0)


def _votes(linked: DataFrame) -> DataFrame:
    """(g, part, size, votes): each part's documents by present shard."""
    by = linked.groupBy("g", "part", "label").agg(F.count("*").alias("n"))
    return by.groupBy("g", "part").agg(F.sum("n").alias("size"), F.collect_list(F.struct("n", "label")).alias("votes"))


def _choice(room: list[int]) -> Column:
    """The shard with room for all of a part that most of its documents are on; else one with room by hash."""
    free = F.lit(room)

    def first(n: Column, shard: Column) -> Column:
        return F.struct(n.alias("n"), F.xxhash64("g", "part", shard).alias("h"), shard.alias("s"))

    voted = F.filter("votes", lambda v: F.get(free, v["label"]) >= F.col("size"))
    best = F.array_max(F.transform(voted, lambda v: first(v["n"], v["label"])))
    fits = F.filter(F.sequence(F.lit(0), F.lit(len(room) - 1)), lambda s: F.get(free, s) >= F.col("size"))
    other = F.array_max(F.transform(fits, lambda s: first(F.lit(0).cast("long"), s)))
    return F.coalesce(best["s"], other["s"])


def _told(rows: DataFrame, groups: DataFrame, key: str, n_rows: int) -> DataFrame:
    """rows left-joined with written groups (one for each key, n its rows): no shuffle while those are few, else with large groups dealt out."""
    if groups.count() <= BROADCAST_WIDE_ROWS:
        return rows.join(F.broadcast(groups.drop("n")), key, "left")
    return spread_join(rows, groups, key, ["doc_id"], n_rows, how="left")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot), one for each row of docs."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    items = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), F.md5(F.encode(text, "utf-8")).alias("g"))
    items = cut(items.withColumn("label", F.pmod(F.xxhash64("doc_id", "g"), F.lit(shards)).cast("int")))
    n = items.count()
    if not n:
        return items.select("doc_id", "size", "text_crc32", F.col("label").alias("shard"), F.lit(0).cast("long").alias("slot"))
    quota = [n // shards + (s < n % shards) for s in range(shards)]
    several = cut(items.groupBy("g").agg(F.count("*").alias("in_group")).filter("in_group > 1").withColumn("n", F.col("in_group")))
    marked = cut(_told(items, several, "g", n).withColumn("in_group", F.coalesce("in_group", F.lit(1).cast("long"))))
    linked = running(marked.filter("in_group > 1"), "nth", F.lit(1), ["g"], ["doc_id", "label"], buckets_for(n))
    linked = cut(linked.withColumn("part", F.floor(F.col("nth") / max(1, n // shards)).cast("long")).drop("nth", "in_group"))
    waiting, room, settled = cut(_votes(linked)), list(quota), []
    for share in chain(ROUNDS, repeat(0)):
        # rounds by size; a part needs at least one document's room
        least = n // shards // share if share else 0
        turn = waiting.filter(F.col("size") >= least).withColumn("to", _choice(room)).filter("to is not null")
        queue = running(turn.select("g", "part", "size", "to"), "ahead", F.col("size"), ["to"], ["g", "part"], buckets_for(n))
        taken = cut(queue.filter(F.col("ahead") + F.col("size") <= F.get(F.lit(room), F.col("to"))).select(F.col("g").alias("s_g"), F.col("part").alias("s_part"), "size", F.col("to").alias("shard")))
        got = {r["shard"]: r["s"] for r in taken.groupBy("shard").agg(F.sum("size").alias("s")).collect()}  # a row for each shard
        if got:
            settled.append(taken)
            room = [x - got.get(s, 0) for s, x in enumerate(room)]
            waiting = cut(waiting.join(taken, (F.col("g") == F.col("s_g")) & (F.col("part") == F.col("s_part")), "left_anti"))
        elif not share:
            break
    cols = ["doc_id", "size", "text_crc32", "shard"]
    free = marked.filter("in_group = 1").select("doc_id", "size", "text_crc32", "label")
    done = None
    if settled:
        every = settled[0]
        for s in settled[1:]:
            every = every.union(s)
        key = lambda g, part: F.concat_ws(":", g, part)
        every = cut(every.select(key("s_g", "s_part").alias("at"), "shard", F.col("size").alias("n")))
        moved = cut(_told(linked.withColumn("at", key("g", "part")), every, "at", n))
        done = moved.filter("shard is not null").select(*cols)
        free = free.union(moved.filter("shard is null").select("doc_id", "size", "text_crc32", "label"))
    else:
        free = free.union(linked.select("doc_id", "size", "text_crc32", "label"))
    # what has no links fills the shards to their quotas
    upto = [sum(room[: s + 1]) for s in range(shards)]
    place = F.size(F.filter(F.lit(upto), lambda x: x <= F.col("nth")))
    filled = running(free, "nth", F.lit(1), [], ["doc_id", "text_crc32"], buckets_for(n)).withColumn("shard", place).select(*cols)
    placed = cut(filled if done is None else done.union(filled))
    return running(placed, "slot", F.lit(1), ["shard"], ["doc_id", "text_crc32"], buckets_for(n))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
