"""URL filters: rules, then logistic regression on hashed character n-grams of host and path. DataFrame functions only.

A URL that a rule fits gets the longest rule's verdict. Any other is scored: trigrams of host and path, whose digits all
count as 0, are hashed to BUCKETS features, a feature's value being its count over the square root of all trigrams, and a probability of 0.5 or more blocks.
Training is full-batch gradient descent with momentum inside one SQL expression over a labelled table; of one with more than
MAX_LABELLED rows, those with the smallest hash of their URL are taken. The expression's array of rows, a few hundred kB at most, is joined
with the one row of its transpose. The BUCKETS + 1 numbers that come out are all that the driver sees and sends.

The built-in table has whole URLs by rule: a topic's word, wanted or not, stands in hosts beside qualifiers that both classes share, and
made-up names stand for sites of no topic, which are wanted; so the topic's trigrams tell, and not the qualifier's or the domain's.

Nulls: a null URL, or one without "://", has an empty host and path; no rule fits and it is scored by the intercept alone.
A null id is carried, repeated rows each give a row, and labelled rows with a null are left out. URLs of any length are read whole.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import cut, let, table

#: (rule's host and path, verdict)
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
BUCKETS = 4096
STEPS = 200
RATE = 6.0
MOMENTUM = 0.9
DECAY = 3e-5
#: Weight of an unwanted example: the table has a quarter as many of them.
UNWANTED_WEIGHT = 4.0
MAX_LABELLED = 2000

#: Topics of the labelled table.
_WANTED = "news wiki library university school science history museum health recipes travel weather garden music forum research journal guide learn article help books photo sport market street farm river city cafe hotel bank energy space video radio track design craft".split()
_UNWANTED = "casino poker jackpot betting bets slots roulette porn xxx adult escort nude sexcam viagra cialis pills pharmacy steroids payday loans bitcoin-bonus warez crack keygen torrent spam clickbait ads adserver popunder malware phishing replica-watches".split()
_QUALIFIERS = "best my online free win top cheap big x".split()
_SYLLABLES = "an ar be con de el er est fo ga hen in ion ka lo mar nor on or per que ra re san sh st ta the ti to tur un ver wes".split()
_DOMAINS = ("example.com", "example.net", "example.org")
_PLACES = ("/", "/en/{n}", "/de/{n}/", "/fr/{n}.html", "/es/{n}", "/about", "/{n}/index.html")


def _urls(name: str, k: int) -> list[str]:
    """Four URLs of a site: its name alone, on a subdomain, before a qualifier and after one."""
    q, d, at = _QUALIFIERS[k % len(_QUALIFIERS)], _DOMAINS, [x.format(n=(k * 37 + i * 911) % 9000) for i, x in enumerate(_PLACES)]
    hosts = (f"{name}.{d[k % 3]}", f"{('www', 'm', 'blog')[k % 3]}.{name}.{d[(k + 1) % 3]}", f"{name}-{q}.{d[(k + 2) % 3]}", f"{q}{'-' * (k % 2)}{name}.{d[k % 3]}")
    return [f"http{'s' * (i % 2)}://{h}{at[(k + i) % len(at)]}" for i, h in enumerate(hosts)]


def labelled(spark: SparkSession) -> DataFrame:
    """(url, blocked, site): the built-in labelled table; a site's URLs have one site."""
    sites = [(w, 0) for w in _WANTED] + [(w, 1) for w in _UNWANTED]
    sites += [("".join(_SYLLABLES[(i * m + i // 3) % len(_SYLLABLES)] for m in (1, 5, 11)[: 2 + i % 2]), 0) for i in range(90)]
    return spark.createDataFrame([(u, y, name) for k, (name, y) in enumerate(sites) for u in _urls(name, k)], "url string, blocked int, site string")


def _lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url.cast("string"), F.lit(""))
    host = _lower(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1))
    path = F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return host, path


def _split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the URL's or a parent of it and whose path begins the URL's; else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # longer ones are tested first, as they wrap the others
        h, p = _split_rule(text)
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def grams(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """Hashed trigrams of host and path, whose ends are marked; a trigram means the same in either."""

    def of(x: Column) -> Column:
        marked = F.concat(F.lit("\x02"), F.translate(x, "123456789", "000000000"), F.lit("\x03"))
        # by code points, as a pattern that looks ahead stops between the halves of a surrogate pair
        three = let(F.split(marked, ""), lambda c: F.transform(F.slice(c, 1, F.greatest(F.size(c) - 2, F.lit(0))), lambda a, i: F.concat(a, F.get(c, i + 1), F.get(c, i + 2))))
        return F.transform(three, lambda g: F.pmod(F.xxhash64(g), F.lit(buckets)).cast("int"))

    return F.concat(of(host), of(path))


def _dot(sparse: Column, dense: Column) -> Column:
    """Of an array of (at, v) with an array."""
    return F.aggregate(sparse, F.lit(0.0), lambda s, e: s + e["v"] * F.get(dense, e["at"]))


def train(examples: DataFrame, url_col: str = "url", label_col: str = "blocked", buckets: int = BUCKETS, steps: int = STEPS) -> list[float]:
    """Weights of the buckets and, last, the intercept, from MAX_LABELLED rows at most; all 0, which allows nothing, without any."""
    rows = examples.select(F.col(f"`{url_col}`").alias("url"), F.col(f"`{label_col}`").cast("double").alias("y")).filter("url is not null and y is not null")
    rows = cut(rows.orderBy(F.xxhash64("url"), "url", "y").limit(MAX_LABELLED))
    n = rows.count()
    if not n:
        return [0.0] * (buckets + 1)
    host, path = host_and_path(F.col("url"))
    g = rows.select("url", "y", grams(host, path, buckets).alias("g"))
    norm = F.sqrt(F.greatest(F.size("g"), F.lit(1)).cast("double"))
    x = F.transform(F.array_sort(F.array_distinct("g")), lambda b: F.struct(b.alias("at"), (F.size(F.filter("g", lambda h: h == b)) / norm).alias("v")))
    g = g.select("url", "y", F.concat(x, F.array(F.struct(F.lit(buckets).alias("at"), F.lit(1.0).alias("v")))).alias("x"))
    # one row of all examples in order; written, as an inlined array would be computed for each element that is read of it
    one = cut(g.groupBy().agg(F.array_sort(F.collect_list(F.struct("url", "y", "x"))).alias("e")).select(F.transform("e", lambda e: e["y"]).alias("y"), F.transform("e", lambda e: e["x"]).alias("x")))
    # and by feature, for the gradient
    cells = one.select(F.posexplode("x").alias("i", "r")).select("i", F.explode("r").alias("c")).groupBy("c.at").agg(F.array_sort(F.collect_list(F.struct(F.col("i").alias("at"), F.col("c.v").alias("v")))).alias("l"))
    empty = F.array().cast("array<struct<at:int,v:double>>")
    by = cells.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("at", "l"))).alias("m"))
    xt = by.select(F.transform(F.sequence(F.lit(0), F.lit(buckets)), lambda j: F.coalesce(F.try_element_at("m", j), empty)).alias("xt"), F.lit(0).alias("k"))
    one = cut(one.withColumn("k", F.lit(0)).join(xt, "k"))

    def step(at: Column, t: Column) -> Column:
        errors = F.transform("x", lambda r, i: (1 / (1 + F.exp(-_dot(r, at["w"]))) - F.get("y", i)) * F.when(F.get("y", i) > 0, UNWANTED_WEIGHT).otherwise(1.0))
        slope = lambda err: F.transform(at["w"], lambda wj, j: _dot(F.get("xt", j), err) / n + DECAY * F.when(j < buckets, wj).otherwise(0.0))
        pace = let(errors, lambda err: F.zip_with(at["v"], slope(err), lambda v, d: MOMENTUM * v - RATE * d))
        return let(pace, lambda v: F.struct(F.zip_with(at["w"], v, lambda a, b: a + b).alias("w"), v.alias("v")))

    zeros = F.array_repeat(F.lit(0.0), buckets + 1)
    out = one.select(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(zeros.alias("w"), zeros.alias("v")), step, lambda at: at["w"]).alias("w"))
    return list(out.first()["w"])


def judge(pages: DataFrame, weights: list[float], url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """pages' other columns with host, path, rule, verdict and block_probability (columns of these names are replaced)."""
    own = ("host", "path", "rule", "verdict", "block_probability")
    d = pages.drop(*own)
    cols = [F.col(f"`{c}`") for c in d.columns]
    host, path = host_and_path(F.col(f"`{url_col}`"))
    d = d.select(*cols, host.alias("host"), path.alias("path"))
    g = grams(F.col("host"), F.col("path"), len(weights) - 1)
    d = d.select(*cols, "host", "path", g.alias("__brindle_grams"))
    table_ = F.array(*[F.lit(x) for x in weights[:-1]])
    score = F.lit(weights[-1]) + F.aggregate("__brindle_grams", F.lit(0.0), lambda s, b: s + F.get(table_, b)) / F.sqrt(F.greatest(F.size("__brindle_grams"), F.lit(1)).cast("double"))
    empty = (F.col("host") == "") & (F.col("path") == "")
    p = 1 / (1 + F.exp(-F.when(empty, F.lit(weights[-1])).otherwise(score)))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    d = d.withColumn("block_probability", p).withColumn("rule", rule).withColumn("__brindle_said", verdict)
    said = F.coalesce("__brindle_said", F.when(F.col("block_probability") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return d.select(*cols, "host", "path", "rule", said.alias("verdict"), "block_probability")


def score_one(url: str | None, weights: list[float], hashed) -> float:
    """What judge() computes, in plain Python, given the bucket function hashed(trigram); for tests."""
    text = url or ""
    rest = text.split("://", 1)[1] if "://" in text else ""
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = rest[: min([i for i in map(rest.find, "?#") if i >= 0], default=len(rest))]
    got = [hashed(m[i : i + 3]) for m in (re.sub("[0-9]", "0", f"\x02{x}\x03") for x in (host, path)) for i in range(len(m) - 2)]
    score = weights[-1] + (sum(weights[b] for b in got) / math.sqrt(max(1, len(got))) if host or path else 0.0)
    return 1 / (1 + math.exp(-score))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = train(labelled(spark))
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), weights).select("page_id", "host", "path", "rule", "verdict")
