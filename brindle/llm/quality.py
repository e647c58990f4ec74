"""Quality rules with adaptive thresholds from mergeable quantile sketches. DataFrame functions only.

Each document's measures go, as whole numbers, to log-linear histograms: 16 buckets for each doubling, so a quantile is told to
1/16 of its value. Histograms merge by adding counts: of partitions to a (lang, source) sketch, of those to a language's, of
those to one of all documents. A measure's fences are median + FENCE * max(median - lower quartile, its floor) and, where a low value is
bad as well, median - FENCE * max(upper quartile - median, its floor), from the smallest of these sketches that has MIN_DOCS documents.
So junk on one side of the median, up to half of a group, doesn't widen the fence that it should meet, and however many documents lie
beyond a fence, none is kept; floors are the least spread where half a group has one value. A document is held against the fences of its
own language and source; sketches count all documents.

Nulls: a null text counts as empty. Null lang or source are groups of their own, null ids are carried. Repeated rows each count and
give a row. A text without words has measures 0 and fails the base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import GAP, WORD, cut, table

SYMBOLS = "[#*$%&|<>]"
RUN = 5
MIN_DOCS = 200
#: Groups whose thresholds (about 100 bytes each) are broadcast at most; beyond, the join shuffles.
BROADCAST_GROUPS = 50_000
#: Spreads between median and fence.
FENCE = 6
#: measure: (numerator, denominator) in units of 1/10000, whether a low value is bad as well, and the least spread in those units
MEASURES = {
    "symbols": ("n_symbols", "word_chars", False, 50),
    "dup_lines": ("n_dup_lines", "n_lines", False, 500),
    "repeats": ("n_repeat_words", "n_words", False, 250),
    "word_length": ("word_chars", "n_words", True, 3000),
}


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows (doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words), one for each row of docs."""
    d = docs.select(*[F.col(f"`{c}`").cast("string").alias(n) if n != "doc_id" else F.col(f"`{c}`").alias(n) for c, n in ((id_col, "doc_id"), (lang_col, "lang"), (source_col, "source"))], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("words", F.filter(F.split("text", GAP, -1), lambda w: w != "")).withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)))
    d = d.select(
        "doc_id", "lang", "source", "words", F.size("words").alias("n"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        (F.size(F.split("text", SYMBOLS, -1)) - 1).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    none = F.array().cast("array<bigint>")
    window = F.transform(F.sequence(F.lit(0), F.col("n") - RUN), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(RUN)]))
    d = d.withColumn("runs", F.when(F.col("n") >= RUN, window).otherwise(none)).drop("words")
    twice = F.size(F.array_distinct("runs")) < F.size("runs")
    d = d.withColumn("sorted", F.when(twice, F.sort_array(F.transform("runs", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("runs")

    def same(x: Column, j: Column) -> Column:
        return F.coalesce(F.get("sorted", j)["h"] == x["h"], F.lit(False))

    at = F.sort_array(F.array_compact(F.transform("sorted", lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"]))))
    d = d.withColumn("at", at)
    # a run's words up to the next run that was found
    covered = F.aggregate(F.transform("at", lambda p, j: F.least(F.lit(RUN), F.coalesce(F.get("at", j + 1) - p, F.lit(RUN)))), F.lit(0), lambda a, x: a + x)
    return d.select("doc_id", "lang", "source", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _value(num: str, den: str) -> Column:
    return F.when(F.col(den) > 0, F.floor(F.col(num) * 10_000 / F.col(den))).otherwise(F.lit(0)).cast("long")


def bucket(x: Column) -> Column:
    """Log-linear bucket of a whole number of 0 or more: exact below 16, then 16 for each doubling."""
    shift = F.greatest(F.length(F.bin(x)) - 5, F.lit(0))
    return (shift * 16 + F.call_function("shiftright", x, shift)).cast("long")


def sketches(measured: DataFrame) -> DataFrame:
    """(level, lang, source, measure, bucket, n): histograms of each (lang, source), each language and all documents."""
    each = F.array(*[F.struct(F.lit(m).alias("measure"), bucket(_value(num, den)).alias("bucket")) for m, (num, den, *_) in MEASURES.items()])
    own = measured.select("lang", "source", F.explode(each).alias("e")).groupBy("lang", "source", "e.measure", "e.bucket").agg(F.count("*").alias("n"))
    none = F.lit(None).cast("string")
    of_lang = own.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n")).withColumn("source", none)
    of_all = own.groupBy("measure", "bucket").agg(F.sum("n").alias("n")).withColumn("source", none).withColumn("lang", none)
    cols = ["level", "lang", "source", "measure", "bucket", "n"]
    return own.withColumn("level", F.lit(0)).select(*cols).union(of_lang.withColumn("level", F.lit(1)).select(*cols)).union(of_all.withColumn("level", F.lit(2)).select(*cols))


def value_of(b: Column) -> Column:
    """The smallest value of a bucket."""
    shift = F.greatest(F.floor(b / 16) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", (b - shift * 16).cast("long"), shift)


def quantiles(sketch: DataFrame) -> DataFrame:
    """(level, lang, source, measure, total, q25, q50, q75): quartiles as values."""
    by = ["level", "lang", "source", "measure"]
    w = Window.partitionBy(*by).orderBy("bucket")
    s = sketch.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))

    def q(percent: int) -> Column:
        return value_of(F.min(F.when(F.col("upto") * 100 >= F.col("total") * percent, F.col("bucket"))))

    return s.groupBy(*by, "total").agg(*[q(p).alias(f"q{p}") for p in (25, 50, 75)])


def thresholds(measured: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, and for each measure lo_ and hi_, as values; kept documents lie between)."""
    least = F.coalesce(*[F.when(F.col("measure") == m, F.lit(floor)) for m, (*_, floor) in MEASURES.items()])
    q = quantiles(sketches(measured)).withColumn("lo", F.col("q50") - FENCE * F.greatest(F.col("q75") - F.col("q50"), least)).withColumn("hi", F.col("q50") + FENCE * F.greatest(F.col("q50") - F.col("q25"), least))
    fence = F.struct("lo", "hi")
    wide = q.groupBy("level", "lang", "source").agg(F.max("total").alias("total"), *[F.max(F.when(F.col("measure") == m, fence)).alias(m) for m in MEASURES])
    own = wide.filter("level = 0").alias("o")
    lang = wide.filter("level = 1").alias("l")
    top = wide.filter("level = 2").alias("t")  # a single row
    joined = own.join(lang, F.col("o.lang").eqNullSafe(F.col("l.lang")), "left").join(F.broadcast(top), F.col("t.level") == F.col("o.level") + 2, "left")

    def pick(m: str) -> Column:
        return F.when(F.col("o.total") >= min_docs, F.col(f"o.{m}")).when(F.col("l.total") >= min_docs, F.col(f"l.{m}")).otherwise(F.col(f"t.{m}"))

    return joined.select(F.col("o.lang").alias("t_lang"), F.col("o.source").alias("t_source"), *[pick(m)[e].alias(f"{e}_{m}") for m in MEASURES for e in ("lo", "hi")])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS) -> DataFrame:
    """measure()'s columns with base_failed, outside (measures beyond a fence) and kept."""
    measured = cut(measure(docs, id_col, text_col, lang_col, source_col))
    told = cut(thresholds(measured, min_docs))
    side = F.broadcast(told) if told.count() <= BROADCAST_GROUPS else told
    d = measured.join(side, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")

    def beyond(m: str, num: str, den: str, both: bool) -> Column:
        x = _value(num, den)
        return (x > F.col(f"hi_{m}")) | (x < F.col(f"lo_{m}")) if both else x > F.col(f"hi_{m}")

    outside = F.array_compact(F.array(*[F.when(beyond(m, *x[:3]), F.lit(m)) for m, x in MEASURES.items()]))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return d.select(*measured.columns, failed.alias("base_failed"), outside.alias("outside")).withColumn("kept", ~F.col("base_failed") & (F.size("outside") == 0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle(min_docs: int = MIN_DOCS) -> str:
    each = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{m}' AS measure, {both} AS two_sided, CASE WHEN {den} > 0 THEN floor({num} * 10000 / {den})::BIGINT ELSE 0 END AS x, {floor} AS floor FROM base" for m, (num, den, both, floor) in MEASURES.items())
    fences = f"q50 - {FENCE} * greatest(q75 - q50, floor) AS lo, q50 + {FENCE} * greatest(q50 - q25, floor) AS hi"
    qs = ", ".join(f"min(low) FILTER (upto * 100 >= total * {p}) AS q{p}" for p in (25, 50, 75))
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS x FROM d, unnest(range(1, len(w) - 3)) AS u(i) WHERE len(w) >= 5),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
gap AS (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS g FROM rep),
reps AS (SELECT doc_id, sum(g)::BIGINT AS n FROM gap GROUP BY doc_id),
base AS (SELECT l.doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM l LEFT JOIN reps ON l.doc_id = reps.doc_id),
m AS ({each}),
b AS (SELECT *, (x >> greatest(length(bin(x)) - 5, 0)) << greatest(length(bin(x)) - 5, 0) AS low FROM m),
s AS (SELECT 0 AS level, lang, source, measure, floor, low, count(*) AS n FROM b GROUP BY lang, source, measure, floor, low
  UNION ALL SELECT 1, lang, NULL, measure, floor, low, count(*) FROM b GROUP BY lang, measure, floor, low
  UNION ALL SELECT 2, NULL, NULL, measure, floor, low, count(*) FROM b GROUP BY measure, floor, low),
c AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY low) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM s),
q AS (SELECT level, lang, source, measure, floor, total, {qs} FROM c GROUP BY level, lang, source, measure, floor, total),
f AS (SELECT *, {fences} FROM q),
pick AS (SELECT o.lang, o.source, o.measure, CASE WHEN o.total >= {min_docs} THEN o.lo WHEN l.total >= {min_docs} THEN l.lo ELSE t.lo END AS lo, CASE WHEN o.total >= {min_docs} THEN o.hi WHEN l.total >= {min_docs} THEN l.hi ELSE t.hi END AS hi
  FROM f o LEFT JOIN f l ON l.level = 1 AND l.measure = o.measure AND l.lang IS NOT DISTINCT FROM o.lang LEFT JOIN f t ON t.level = 2 AND t.measure = o.measure WHERE o.level = 0),
bad AS (SELECT DISTINCT doc_id FROM b JOIN pick p ON p.measure = b.measure AND p.lang IS NOT DISTINCT FROM b.lang AND p.source IS NOT DISTINCT FROM b.source WHERE x > hi OR (two_sided AND x < lo))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept
FROM base
"""


ORACLE = oracle()
