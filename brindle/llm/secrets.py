"""Secret scans: a trigram inverted index in front of regular expressions. DataFrame functions only.

Each rule's pattern is parsed to a Boolean query over trigrams (in lower case) that any match must satisfy, as alternatives of
mandatory trigrams. The index holds postings (trigram, row) for the trigrams that the rules' queries name. Postings are
intersected by counting, for each row and alternative, how many of its trigrams have a posting; rows that fulfil an
alternative are candidates of its rule and are verified by the pattern itself. A rule without mandatory trigrams (the hex
rule) verifies every row.

Matches are leftmost and don't overlap within a kind; spans are code points, end exclusive. Positions come from the pieces
between matches: a match starts at the summed lengths of what stands before it.

Nulls: a null text counts as empty; a null id is carried. Repeated rows each give a row. A row's key is a hash of its id and
text: rows that share a key share candidates, which are verified for each row, so a hash collision can't change a result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import BROADCAST_WIDE_ROWS, cut, let, table

_c, _p = re._constants, re._parser
#: Strings that a part of a pattern may stand for are listed up to so many.
_MOST = 64
_CHUNK = 256


def _any_case(word: str) -> str:
    return "".join(f"[{x.upper()}{x}]" if x.isalpha() else x for x in word)


@dataclass(frozen=True)
class Rule:
    """least: code points that the match, or the group if one is named, must have."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


_ASSIGN_WORDS = "|".join([*map(_any_case, ("password", "passwd", "secret", "token")), _any_case("api") + "_?" + _any_case("key")])
BASE = (
    Rule("assign", f"({_ASSIGN_WORDS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]{24,}", 0, 24),
)
ADDED = (
    Rule("pem", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("hub", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{10,}[.]eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}"),
    Rule("maps", "AIza[A-Za-z0-9_-]{35}"),
    Rule("live", "[rs]k_live_[A-Za-z0-9]{16,}"),
)


def _exact(tree) -> tuple[set[str] | None, list[set[str]]]:
    """All strings that the tree stands for, if few; and sets of strings, one of each of which any match contains."""
    need, cur = [], {""}

    def flush() -> None:
        nonlocal cur
        if cur != {""}:
            need.append(cur)
        cur = {""}

    whole = True
    for op, arg in tree:
        got, inner = None, []
        if op is _c.LITERAL:
            got = {chr(arg).lower()}
        elif op is _c.AT:
            got = {""}
        elif op is _c.IN and arg[0][0] is not _c.NEGATE:
            chars = set()
            for kind, x in arg:
                chars |= {chr(x).lower()} if kind is _c.LITERAL else {chr(y).lower() for y in range(x[0], min(x[1] + 1, x[0] + _MOST))} if kind is _c.RANGE else {str(i) for i in range(_MOST)}
            got = chars if len(chars) <= 8 else None
        elif op is _c.SUBPATTERN:
            got, inner = _exact(arg[3])
        elif op is _c.BRANCH:
            parts = [_exact(x) for x in arg[1]]
            if all(x is not None for x, _ in parts):
                got = set().union(*(x for x, _ in parts))
            elif all(x is not None or y for x, y in parts):
                # any alternative needs the first thing that it needs
                inner = [set().union(*(x if x is not None else y[0] for x, y in parts))]
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT):
            least, most, sub = arg
            x, y = _exact(sub)
            if x is not None and (least, most) == (0, 1):
                got = x | {""}
            elif x is not None and least == most and len(x) ** int(least) <= _MOST:
                got = {"".join(z) for z in product(x, repeat=int(least))}
            elif least:
                inner = y if x is None else [x]
        if got is None or len(got) > _MOST:
            flush()
            need += inner
            whole = False
        else:
            if len(cur) * len(got) > _MOST:
                flush()
                whole = False
            cur = {a + b for a in cur for b in got}
    if whole:
        return cur, []
    flush()
    return None, need


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of trigrams (in lower case): a match has all trigrams of one of them. [frozenset()]: no mandatory trigrams."""
    got, need = _exact(_p.parse(pattern))
    sets = [got] if got is not None else need
    out = [frozenset()]
    for strings in sets:
        if any(len(s) < 3 for s in strings):
            continue
        # a string that contains another is told by the other
        strings = {s for s in strings if not any(t != s and t in s for t in strings)}
        if len(out) * len(strings) <= _MOST:
            out = [a | {s[i : i + 3] for i in range(len(s) - 2)} for a in out for s in sorted(strings)]
    return sorted({x for x in out if not any(y < x for y in out)}, key=sorted)


def postings(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index over `trigrams`: (trigram, key) for each row of (key, text) that has it, in lower case."""
    low = rows.select("key", F.lower("text").alias("low"))
    return low.select("key", F.explode(F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, kinds): rows with all trigrams of one alternative of a rule. A trigram counts once for a key, however many rows share the key."""
    terms = [(r.kind, n, len(alt), t, i // 62, 1 << i % 62) for r in rules for n, alt in enumerate(trigram_query(r.pattern)) for i, t in enumerate(sorted(alt))]
    # one row for each trigram of a rule: as many as the rules' literals have letters
    of = F.broadcast(index.sparkSession.createDataFrame(terms, "kind string, alt int, n_terms int, trigram string, word int, bit long"))
    words = [F.bit_or(F.when(F.col("word") == w, F.col("bit"))) for w in range(max(x[4] for x in terms) + 1)]
    n_met = sum((F.bit_count(F.coalesce(w, F.lit(0).cast("long"))) for w in words), F.lit(0))
    met = index.join(of, "trigram").groupBy("key", "kind", "alt", "n_terms").agg(n_met.alias("n")).filter(F.col("n") == F.col("n_terms"))
    return met.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _spans(text: Column, rule: Rule, order: int, found: Column) -> Column:
    """Structs (start, ord, end) of the matches in `found` (all of them, in order) that are long enough."""
    none = F.array().cast("array<struct<start:int,ord:int,end:int>>")

    def total(a: Column, start: Column, n: Column) -> Column:
        return F.aggregate(F.slice(a, start, n), F.lit(0), lambda x, y: x + y)

    def chunk_of(i: Column) -> Column:
        return F.floor(i / _CHUNK).cast("int")

    def steps(m: Column) -> Column:
        return let(F.split(text, rule.pattern, -1), lambda between: F.transform(m, lambda x, i: F.length(F.get(between, i)) + F.length(x)))

    def ends(step: Column) -> Column:
        # running sums by chunks, as slices from the beginning would cost the square of the matches
        sums = F.transform(F.sequence(F.lit(0), chunk_of(F.size(step) - 1)), lambda c: total(step, c * _CHUNK + 1, F.lit(_CHUNK)))
        before = let(sums, lambda s: F.transform(s, lambda x, c: total(s, F.lit(1), c)))
        return let(before, lambda b: F.transform(step, lambda x, i: F.get(b, chunk_of(i)) + total(step, chunk_of(i) * _CHUNK + 1, i % _CHUNK + 1)))

    def spans(m: Column, end: Column, told: Column) -> Column:
        every = F.transform(m, lambda x, i: F.struct((F.get(end, i) - F.length(x)).alias("start"), F.lit(order).alias("ord"), F.get(end, i).alias("end"), F.length(F.get(told, i)).alias("told")))
        return F.transform(F.filter(every, lambda s: s["told"] >= rule.least), lambda s: F.struct(s["start"], s["ord"], s["end"]))

    told = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    all_of = let(found, lambda m: let(let(steps(m), ends), lambda end: let(told, lambda t: spans(m, end, t))))
    return F.when(F.size(found) == 0, none).otherwise(all_of)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """Rows (doc_id, spans): spans is an array of (start, kind, end), by start and then kind as listed in rules."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = tuple(r for r in rules if all(queries[r.kind]))
    trigrams = sorted({t for r in indexed for alt in queries[r.kind] for t in alt})
    if trigrams:
        # few rows are candidates, so their keys go to the texts and not the texts to the keys, unless there are too many
        got = cut(candidates(postings(src, trigrams), indexed))
        src = src.join(F.broadcast(got) if got.count() <= BROADCAST_WIDE_ROWS else got, "key", "left")
    else:
        src = src.withColumn("kinds", F.lit(None).cast("array<string>"))
    nothing = F.array().cast("array<string>")
    for i, r in enumerate(rules):
        all_of = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))
        src = src.withColumn(f"m{i}", F.when(F.array_contains("kinds", r.kind), all_of).otherwise(nothing) if r in indexed else all_of)
    src = src.select("doc_id", *[_spans(F.col("text"), r, i, F.col(f"m{i}")).alias(f"s{i}") for i, r in enumerate(rules)])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    every = F.sort_array(F.concat(*[F.col(f"s{i}") for i in range(len(rules))]))
    return src.select("doc_id", F.transform(every, lambda s: F.struct(s["start"], F.get(kinds, s["ord"]).alias("kind"), s["end"])).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE]))

    def n(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return out.select("doc_id", *[n(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    each = " UNION ALL ".join(f"SELECT doc_id, {i} AS ord, {quote(r.kind)} AS kind, {r.least} AS least, regexp_extract_all(text, {quote(r.pattern)}, 0) AS m, regexp_extract_all(text, {quote(r.pattern)}, {r.group}) AS g, regexp_split_to_array(text, {quote(r.pattern)}) AS p FROM t" for i, r in enumerate(BASE + ADDED))
    base = ", ".join(quote(r.kind) for r in BASE)
    counts = ", ".join(f"count(*) FILTER (kind = {quote(r.kind)}) AS n_{r.kind}" for r in BASE)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
k AS ({each}),
u AS (SELECT doc_id, ord, kind, least, unnest(m) AS m, unnest(g) AS g, unnest(p[1:len(m)]) AS p, unnest(range(len(m))) AS i FROM k WHERE len(m) > 0),
s AS (SELECT *, sum(length(p) + length(m)) OVER (PARTITION BY doc_id, ord ORDER BY i) AS e FROM u),
f AS (SELECT doc_id, ord, kind, (e - length(m))::BIGINT AS b, e::BIGINT AS e FROM s WHERE length(g) >= least),
a AS (SELECT doc_id, {counts}, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, ord) FILTER (kind IN ({base})) AS base, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, ord) AS spans FROM f GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN a ON t.doc_id IS NOT DISTINCT FROM a.doc_id
"""


ORACLE = _oracle()
