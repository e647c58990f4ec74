"""Generations: diff, ancestry, dependencies, prune and consolidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.ordered import running_ordered
from brindle.sources.catalog import staged


def diff(old: DataFrame, new: DataFrame, key: str = "name", same: list[str] | None = None) -> DataFrame:
    """Full outer join of two manifests: name, change (inherited, changed, added, dropped), and both sides' columns prefixed."""
    same = same or ["content_hash", "length"]
    o = old.select(F.col(key).alias("_o"), *[F.col(c).alias(f"old_{c}") for c in same])
    n = new.select(F.col(key).alias("_n"), *[F.col(c).alias(f"new_{c}") for c in same])
    equal = F.lit(True)
    for c in same:
        equal = equal & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "dropped").when(equal, "inherited").otherwise("changed")
    return o.join(n, F.col("_o") == F.col("_n"), "full_outer").select(F.coalesce("_o", "_n").alias(key), change.alias("change"), *[f"old_{c}" for c in same], *[f"new_{c}" for c in same])


def lineage(generations: DataFrame, max_doublings: int = 40) -> DataFrame:
    """(generation, ancestor, depth) for every generation and itself, of (generation, parent), by doubling the distance that is known.

    A chain of n generations takes log2(n) joins. A cycle, or a parent that isn't there, raises ValueError.
    """
    step = staged(generations.select("generation", F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("depth")).filter("ancestor is not null"))
    if step.join(generations.select(F.col("generation").alias("ancestor")), "ancestor", "left_anti").limit(1).count():
        raise ValueError("a generation's parent is missing")
    n = generations.count()
    known = generations.select("generation", F.col("generation").alias("ancestor"), F.lit(0).cast("long").alias("depth"))
    jump, reach = step, 1  # jump: pairs exactly `reach` apart
    for _ in range(max_doublings):
        on = jump.select(F.col("generation").alias("ancestor"), F.col("ancestor").alias("further"), F.col("depth").alias("more"))
        far = known.join(on, "ancestor").select("generation", F.col("further").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        known = staged(known.union(far))
        reach *= 2
        jump = staged(jump.join(on, "ancestor").select("generation", F.col("further").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth")))
        if jump.isEmpty():
            return known
        if reach > n:
            break
    raise ValueError("generations go round in a cycle")


def nearest(files: DataFrame, effective: DataFrame, ancestry: DataFrame) -> DataFrame:
    """effective (generation, file_id) with owner: the nearest ancestor that holds the file's packet (files: generation, file_id)."""
    f = files.select(F.col("generation").alias("ancestor"), "file_id")
    j = effective.join(F.broadcast(ancestry), "generation").join(f, ["ancestor", "file_id"])  # ancestry has a row for each pair of a chain
    return j.groupBy("generation", "file_id").agg(F.max("ancestor").alias("owner"))


def superseded(entries: DataFrame, head: DataFrame, keys: list[str]) -> DataFrame:
    """Entries that the head doesn't hold as they are."""
    return entries.join(head, keys, "left_anti")


def owner_of(extents: DataFrame, generations: DataFrame, offset: str = "stream_offset", length: str = "length") -> DataFrame:
    """extents with the generation whose range holds them; generations (one row each) are broadcast."""
    g = generations.select(F.col("generation").alias("owner"), "stream_base", "stream_length")
    inside = (F.col(offset) >= F.col("stream_base")) & (F.col(offset) + F.col(length) <= F.col("stream_base") + F.col("stream_length"))
    return extents.join(F.broadcast(g), inside, "left").drop("stream_base", "stream_length")


def dependencies(owned: DataFrame, entry: str = "name") -> DataFrame:
    return owned.groupBy("owner").agg(F.countDistinct(entry).alias("entries"), F.sum("length").alias("bytes"))


def orphans(entries: DataFrame, owned: DataFrame, removed: list[int], entry: str = "name") -> DataFrame:
    """Entries with an extent in a removed generation."""
    return entries.join(owned.filter(F.col("owner").isin(removed)).select(entry).distinct(), entry, "left_semi")


def interned(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Distinct keys with posix_index: their place by first appearance (order is unique)."""
    first = staged(rows.groupBy(*keys).agg(F.min(order).alias("first_seen")))
    return running_ordered(first, "first_seen", F.lit(1), "posix_index")


def presence(layout: DataFrame, volumes: DataFrame) -> DataFrame:
    """Layout rows with present: recovery volumes by name, data volumes by size and tag."""
    v = volumes.select(F.col("name").alias("_name"), F.col("bytes").alias("_bytes"), F.col("tag").alias("_tag")).dropDuplicates(["_bytes", "_tag"])
    data = layout.filter("kind = 'data'").join(v, (F.col("bytes") == F.col("_bytes")) & (F.col("tag") == F.col("_tag")), "left")
    names = volumes.select(F.col("name").alias("_name")).distinct()
    rest = layout.filter("kind <> 'data'").join(names, F.col("name") == F.col("_name"), "left")
    pick = [*layout.columns, F.col("_name").isNotNull().alias("present")]
    return data.select(*pick).union(rest.select(*pick))


def conflicts(packets: DataFrame, keys: list[str], body: str, order: str) -> DataFrame:
    """First copy of each packet, copies and conflicting bodies."""
    return packets.groupBy(*keys).agg(F.min(F.struct(F.col(order), F.col(body)))[body].alias("first_body"), F.count("*").alias("copies"), (F.countDistinct(body) - 1).alias("conflicts"))


def stale(old: Column, new: Column, policy: str, hash_differs: Column) -> Column:
    """Rescan rule: stat compares what is given, hash the content, none trusts."""
    return {"none": F.lit(False), "hash": hash_differs, "stat": ~old.eqNullSafe(new)}[policy]
