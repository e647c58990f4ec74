"""Rules of manifests and generations: entry fields, extents, links, selection, prune, preserved metadata, owners, short names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import text

#: metadata classes by bit
CLASSES = ("mode", "times", "owner", "xattr", "attrs", "links")
DEFAULT_CLASSES = ("mode", "times", "links")


def valid_utf8(raw: Column) -> Column:
    """Whether bytes are UTF-8 (shortest forms, no surrogates, up to U+10FFFF); null stays null."""
    return F.is_valid_utf8(raw.cast("binary")) if hasattr(F, "is_valid_utf8") else F.decode(raw, "utf-8").isNotNull()


def entry_status(entries: DataFrame) -> DataFrame:
    """entries (name, entry_type, length, n_extents, target, content_hash) with status: ok or the first rule that fails.

    Regular entries have no target, directories and symlinks no content, and a hard link's target is another entry, regular and of
    the same content and length.
    """
    t = entries.select(F.col("name").alias("_t_name"), F.col("entry_type").alias("_t_type"), F.col("content_hash").alias("_t_hash"), F.col("length").alias("_t_length"))
    d = entries.join(t, (F.col("entry_type") == "hardlink") & (F.col("target") == F.col("_t_name")), "left")
    kind, has_target = F.col("entry_type"), F.coalesce(F.octet_length("target"), F.lit(0)) > 0
    empty = kind.isin("directory", "symlink")
    link = kind == "hardlink"
    status = (
        F.when(text.path_status(F.col("name")) != "ok", "path").when(~kind.isin("regular", "directory", "symlink", "hardlink"), "type")
        .when(empty & (F.col("length") != 0), "type_length").when((empty | link) & (F.col("n_extents") > 0), "type_extents")
        .when(kind.isin("regular", "directory") & has_target, "type_extra").when((kind == "symlink") & ~F.coalesce(text.link_target_ok(F.col("target")), F.lit(False)), "path")
        .when(link & (F.coalesce(text.path_status(F.col("target")), F.lit("empty")) != "ok"), "path").when(link & F.col("_t_name").isNull(), "link_missing")
        .when(link & (F.col("target") == F.col("name")), "link_self").when(link & (F.col("_t_type") != "regular"), "link_chain")
        .when(link & ~(F.col("content_hash").eqNullSafe(F.col("_t_hash")) & (F.col("length") == F.col("_t_length"))), "link_content").otherwise("ok")
    )
    return d.select(*entries.columns, status.alias("status"))


def within_ancestor(extents: DataFrame, ranges: DataFrame, own_base: int, most: int = 100_000) -> DataFrame:
    """extents (stream_offset, length, ...) below own_base with ok: one range (base, length) of an ancestor holds all of it; others are ok.

    Ranges are a row for each ancestor; more than `most` raise ValueError, as they are broadcast.
    """
    if ranges.count() > most:
        raise ValueError("more ancestors than can be sent to every task")
    one = ranges.agg(F.sort_array(F.collect_list(F.struct("base", (F.col("base") + F.col("length")).alias("end")))).alias("_ranges"))
    end = F.col("stream_offset") + F.col("length")
    inside = F.exists("_ranges", lambda x: (F.col("stream_offset") >= x["base"]) & (end <= x["end"]))
    return extents.crossJoin(F.broadcast(one)).withColumn("ok", (F.col("stream_offset") >= own_base) | inside).drop("_ranges")


def selected(generations: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (pick, number, id_prefix) with set_id and status: ok, missing, ambiguous, or forked where neither is given and a parent has two children.

    generations: (generation, set_id, parent_id). Without a number or prefix the head is taken, which is nobody's parent.
    """
    heads = generations.join(generations.select(F.col("parent_id").alias("_p")).distinct(), F.col("set_id") == F.col("_p"), "left_anti")
    forked = generations.filter("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count() > 0
    head = heads.agg(F.min("set_id").alias("_head"))  # one row
    by = (F.col("number").isNotNull() & (F.col("generation") == F.col("number"))) | (F.col("number").isNull() & F.col("id_prefix").isNotNull() & F.startswith("set_id", F.lower("id_prefix")))
    found = wanted.join(F.broadcast(generations.select("generation", "set_id")), by, "left")  # a row for each generation of a chain
    d = found.groupBy("pick", "number", "id_prefix").agg(F.count("set_id").alias("n"), F.min("set_id").alias("one")).crossJoin(F.broadcast(head))
    default = F.col("number").isNull() & F.col("id_prefix").isNull()
    status = F.when(default, F.lit("forked" if forked else "ok")).when(F.col("n") == 0, "missing").when(F.col("n") > 1, "ambiguous").otherwise("ok")
    return d.select("pick", F.when(status == "ok", F.when(default, F.col("_head")).otherwise(F.col("one"))).alias("set_id"), status.alias("status"))


def prune_plan(generations: DataFrame, before: int | None, listed: list[int]) -> tuple[DataFrame, str]:
    """(generations with removed, verdict): verdict is ok, or why nothing may be pruned: none, all or head."""
    gone = F.lit(False)
    if before is not None:
        gone = gone | (F.col("generation") < before)
    if listed:
        gone = gone | F.col("generation").isin(listed)
    d = generations.withColumn("removed", gone)
    n, removed, head, last = d.agg(F.count("*"), F.sum(F.col("removed").cast("long")), F.max("generation"), F.max(F.when(F.col("removed"), F.col("generation")))).first()
    return d, "none" if not removed else "all" if removed == n else "head" if last == head else "ok"


def keep_mask(preserve: set[str] | None = None, explicit: set[str] | None = None, reproducible: bool = False) -> set[str]:
    """Metadata classes to keep; a reproducible set keeps only those that were asked for by name."""
    kept = set(DEFAULT_CLASSES if preserve is None else preserve)
    return kept & (explicit or set()) if reproducible else kept


def preserved(entries: DataFrame, kept: set[str], columns: dict[str, list[str]]) -> DataFrame:
    """entries with the columns of classes that aren't kept as nulls; columns says which belong to a class."""
    gone = {c for k, cs in columns.items() if k not in kept for c in cs}
    return entries.select(*[F.lit(None).cast(entries.schema[c].dataType).alias(c) if c in gone else F.col(f"`{c}`") for c in entries.columns])


def may_write(slice_tag: Column, forced: Column) -> Column:
    """In-place writes need slice tags to prove what is written, or force."""
    return (slice_tag != "none") | forced


def file_offsets(extents: DataFrame, entry: str, order: str, length: str) -> DataFrame:
    """extents with file_offset, the running sum of an entry's extents before each (an entry's extents meet in one task, as its list is one packet)."""
    w = Window.partitionBy(entry).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return extents.withColumn("file_offset", F.coalesce(F.sum(length).over(w), F.lit(0)).cast("long"))


def recovery_present(recovery: DataFrame, by: str) -> DataFrame:
    """(by, present, top): distinct exponents, and one more than the largest."""
    return recovery.groupBy(by).agg(F.countDistinct("exponent").alias("present"), (F.max("exponent") + 1).alias("top"))


def owner_label(user: Column, uid: Column, mapped: bool = True) -> Column:
    """The owner to restore: the name if names are mapped and there is one, else the number."""
    return F.coalesce(F.when(F.lit(mapped) & (F.octet_length(user) > 0), user), uid.cast("string"))


def short_name(name: Column, taken: Column) -> Column:
    """DOS 8.3 form of a path's last part: upper case, six characters, a tilde and the count of names before it that need the same, and three of the extension."""
    base = F.upper(F.substring_index(name, "/", -1))
    stem = F.regexp_replace(F.when(F.contains(base, F.lit(".")), F.regexp_extract(base, r"^(.*)\.[^.]*$", 1)).otherwise(base), "[^A-Z0-9_-]", "")
    ext = F.regexp_replace(F.when(F.contains(base, F.lit(".")), F.regexp_extract(base, r"\.([^.]*)$", 1)).otherwise(F.lit("")), "[^A-Z0-9_-]", "")
    fits = base.rlike(r"^[A-Z0-9_-]{1,8}(\.[A-Z0-9_-]{1,3})?$")
    return F.when(fits, base).otherwise(F.concat(F.substring(stem, 1, 6), F.lit("~"), (taken + 1).cast("string"), F.when(ext != "", F.concat(F.lit("."), F.substring(ext, 1, 3))).otherwise("")))


def le_hex(n: Column, width: int) -> Column:
    """A whole number's little-endian bytes in lowercase hex."""
    big = F.lpad(F.lower(F.hex(n.cast("long"))), 16, "0")
    return F.concat(*[F.substring(big, 17 - 2 * (i + 1), 2) for i in range(width)])


def le_number(hex_text: Column, width: int) -> Column:
    """The number that le_hex() wrote, for widths below 8 and signed 64-bit numbers."""
    big = F.concat(*[F.substring(hex_text, 2 * (width - i) - 1, 2) for i in range(width)])
    return F.conv(big, 16, -10).cast("long")


def volume_name(name: Column) -> tuple[Column, Column, Column]:
    """(stem, kind, generation) of a volume's file name: stem[.gNNN].(vNN+MM | dNN).ext is recovery or data, stem[.gNNN].ext an index."""
    form = r"^(.*?)(?:\.g(\d+))?(?:\.(v\d+\+\d+|d\d+))?\.[^.]+$"
    part = F.regexp_extract(name, form, 3)
    kind = F.when(part.startswith("v"), "recovery").when(part.startswith("d"), "data").otherwise("index")
    gen = F.regexp_extract(name, form, 2)
    return F.regexp_extract(name, form, 1), kind, F.when(gen != "", gen.cast("int")).otherwise(0)
