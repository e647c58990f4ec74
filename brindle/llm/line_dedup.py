"""Line dedup by site-relative frequency.

A line is boilerplate on a site if more than `ratio` of the site's pages, and at least `min_pages` of them, contain it. Lines
are told by 96 bits of hashes. A page counts once for a line however often it has it, and pages of one site with equal texts count as
one page: a text that was crawled a thousand times is for a copy stage to find, its lines aren't boilerplate for it. As pages / site pages of all lines sum
to the mean lines of a page, a site has at most (mean lines of a page) / ratio boilerplate lines.

Sites are never gathered: pages of a site meet only as counts. The boilerplate lists are broadcast while they are below
BROADCAST_BYTES in all, else joined with pages dealt out by (site, salt).

Nulls: a null text counts as empty, a null site is a site of its own, a null id is carried. Lines without a word are never dropped
and not counted. Repeated rows count as
one page and each give a row. Lines end at line feeds; a text of any length is taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import WORD, cut, table

RATIO = 0.02
MIN_PAGES = 5
BROADCAST_BYTES = 32 << 20
SALTS = 64


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def boilerplate(pages: DataFrame, site: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(b_site, bad): keys of each site's boilerplate lines; sites without any are left out."""
    p = pages.select(site.cast("string").alias("site"), F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1).alias("lines"), F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))).alias("t"))
    # one row for a text of a site before pages are counted
    totals = p.select("site", "t").distinct().groupBy("site").agg(F.count("*").alias("total"))
    lines = p.select("site", "t", F.explode(F.array_distinct(F.transform(F.filter("lines", lambda x: x.rlike(WORD)), _key))).alias("k"))
    counts = lines.distinct().groupBy("site", "k").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    t = totals.select(F.col("site").alias("t_site"), "total")
    often = counts.join(t, F.col("site").eqNullSafe(F.col("t_site"))).filter(F.col("n") > F.col("total") * F.lit(ratio))
    return often.groupBy("site").agg(F.collect_list("k").alias("__brindle_of_bad")).select(F.col("site").alias("__brindle_of_b_site"), "__brindle_of_bad")


def drop_lines(pages: DataFrame, site: Column, text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """pages with `text_col` less its boilerplate lines, and n_lines and n_dropped (columns of these names are replaced)."""
    text = F.col(f"`{text_col}`")
    bad = cut(boilerplate(pages, site, text, ratio, min_pages))
    size = bad.agg(F.sum(F.size("__brindle_of_bad") * 12 + 32)).first()[0] or 0
    d = pages.drop("n_lines", "n_dropped")
    cols = [F.col(f"`{c}`") for c in d.columns]
    d = d.select(*cols, site.cast("string").alias("__brindle_site"))
    if size <= BROADCAST_BYTES:
        j = d.join(F.broadcast(bad), F.col("__brindle_site").eqNullSafe(F.col("__brindle_of_b_site")), "left")
    else:
        salted = bad.withColumn("__brindle_of_b_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        j = d.withColumn("__brindle_salt", F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int"))
        j = j.join(salted, F.col("__brindle_site").eqNullSafe(F.col("__brindle_of_b_site")) & (F.col("__brindle_salt") == F.col("__brindle_of_b_salt")), "left")
    lines = F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)
    j = j.withColumn("__brindle_lines", lines).withColumn("__brindle_kept", F.when(F.col("__brindle_of_bad").isNull(), F.col("__brindle_lines")).otherwise(F.filter("__brindle_lines", lambda x: ~x.rlike(WORD) | ~F.array_contains("__brindle_of_bad", _key(x)))))
    kept = F.when(text.isNull(), F.lit(None).cast("string")).otherwise(F.array_join("__brindle_kept", "\n"))
    out = [kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in d.columns if c != "__brindle_site"]
    return j.select(*out, F.size("__brindle_lines").cast("long").alias("n_lines"), (F.size("__brindle_lines") - F.size("__brindle_kept")).cast("long").alias("n_dropped"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, whose site is their source."""
    out = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), F.col("source"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = rf"""
WITH l AS (SELECT doc_id, source, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
total AS (SELECT source, count(DISTINCT coalesce(text, '')) AS total FROM documents GROUP BY source),
n AS (SELECT source, line, count(DISTINCT text) AS n FROM l WHERE regexp_matches(line, '{WORD}') GROUP BY source, line),
bad AS (SELECT n.source, line FROM n JOIN total ON n.source IS NOT DISTINCT FROM total.source WHERE n >= {MIN_PAGES} AND n > total * {RATIO}),
m AS (SELECT l.doc_id, l.i, l.line, bad.line IS NOT NULL AS gone FROM l LEFT JOIN bad ON l.source IS NOT DISTINCT FROM bad.source AND l.line = bad.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""
