"""Secret scans by a trigram inverted index, with DataFrame operations only.

Each rule's regex is turned into a Boolean query over lower-cased trigrams that every match must hold: side by side they
cover each spelling, so that a third as many are looked for as a spelling has. Postings (trigram, text key) are kept for
the trigrams that some rule asks for; intersecting them gives each rule's candidate texts, on which the regex itself then
runs. A rule whose regex forces no trigram (like a bare run of hex digits) scans every text.

Null texts count as empty: no spans. Repeated rows give repeated results; texts that are equal share a key. An empty table
gives an empty result. A column secret_spans is replaced, all others pass through whatever their names. The work grows
with a text and its matches, not with their square.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import settle, table, unused

#: A regex part with more spellings than this is treated as unknown text.
MOST_SPELLINGS = 64
#: Matches whose positions are summed up together.
TOGETHER = 128


@dataclass(frozen=True)
class Rule:
    """pattern: a regex that Java, RE2 and Python read alike. group, least: matches whose group is shorter are dropped. base: one of the contract's kinds."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    fold: bool = False
    base: bool = False

    @property
    def regex(self) -> str:
        return f"(?i){self.pattern}" if self.fold else self.pattern


#: The kinds in their order, base ones first.
RULES = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, False, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, False, True),  # the maximal runs of [0-9a-f]+ that are long enough
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]


def _spellings(items) -> set[str] | None:
    """All texts that a parsed regex can match, lower-cased; None if there are too many."""
    out = {""}
    for op, arg in items:
        if op is C.LITERAL:
            one = {chr(arg).lower()}
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg):
            one = {chr(a).lower() for _, a in arg}
        elif op is C.SUBPATTERN:
            one = _spellings(arg[-1])
        elif op is C.BRANCH:
            each = [_spellings(x) for x in arg[1]]
            one = None if None in each else set().union(*each)
        elif op is C.MAX_REPEAT and arg[1] is not C.MAXREPEAT and arg[1] <= 4:
            part = _spellings(arg[2])
            one = None if part is None else _spellings_repeated(part, arg[0], arg[1])
        else:
            one = None
        if one is None or len(out) * len(one) > MOST_SPELLINGS:
            return None
        out = {a + b for a in out for b in one}
    return out


def _spellings_repeated(part: set[str], least: int, most: int) -> set[str] | None:
    out, now = set(), {""}
    for k in range(most + 1):
        if k >= least:
            out |= now
        now = {a + b for a in now for b in part}
        if len(now) > MOST_SPELLINGS:
            return None
    return out


def _trigrams(spelling: str) -> frozenset[str]:
    return frozenset(spelling[k : k + 3] for k in range(len(spelling) - 2))


def _cover(spelling: str) -> frozenset[str]:
    """Trigrams side by side, and the last one: all characters are in one of them."""
    return frozenset(spelling[k : k + 3] for k in {*range(0, len(spelling) - 2, 3), len(spelling) - 3})


def _runs(pattern: str) -> list[list[str]]:
    """Runs of known text that a regex forces: of each its spellings, without those that hold another one's trigrams and more."""
    runs: list[set[str]] = [{""}]
    for item in parser.parse(pattern):
        here = _spellings([item])
        if here is None:  # what it must hold stands alone; then unknown text follows
            op, arg = item
            if op is C.MAX_REPEAT and arg[0] >= 1 and (inner := _spellings(arg[2])) is not None:
                runs[-1] = {a + b for a in runs[-1] for b in inner} if len(runs[-1]) * len(inner) <= MOST_SPELLINGS else runs[-1]
            runs.append({""})
        elif len(runs[-1]) * len(here) > MOST_SPELLINGS:
            runs.append(here)
        else:
            runs[-1] = {a + b for a in runs[-1] for b in here}
    return [sorted(x for x in run if not any(_trigrams(y) < _trigrams(x) for y in run)) for run in runs if all(len(x) >= 3 for x in run)]


def trigram_query(pattern: str, trigrams=_trigrams) -> list[list[frozenset[str]]]:
    """A regex as: all of these; each any of these; each all of these trigrams. Empty: the regex forces no trigram."""
    return [sorted({trigrams(x) for x in run}, key=sorted) for run in _runs(pattern)]


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def postings(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """The inverted index (trigram, key) over the trigrams of the rules' queries."""
    asked = sorted({t for r in rules for run in trigram_query(r.pattern, _cover) for alt in run for t in alt})
    lower = docs.select(text_key(F.col(text)).alias("key"), F.lower(text).alias("lower")).where(F.col("lower").isNotNull())
    held = F.filter(F.array(*map(F.lit, asked)), lambda t: F.contains(F.col("lower"), t))
    return lower.select("key", F.explode(held).alias("trigram")).distinct()


def candidates(index: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(key, rules): the texts whose postings satisfy the queries of rules that have one."""
    spark = index.sparkSession
    names = ("kind", "runs", "run", "alt", "size", "trigram")
    rows = [(r.kind, len(q), k, j, len(alt), t) for r in rules if (q := trigram_query(r.pattern, _cover)) for k, run in enumerate(q) for j, alt in enumerate(run) for t in sorted(alt)]
    asked = spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row, strict=True))) for row in rows))))
    met = index.join(F.broadcast(asked), "trigram").groupBy("key", "kind", "runs", "run", "alt", "size").count().where("count = size")  # as many rows as the rules have trigrams
    runs = met.groupBy("key", "kind", "runs").agg(F.count_distinct("run").alias("met")).where("met = runs")
    return runs.groupBy("key").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end, kind): code points of the matches that hold.

    A match begins after all gaps and matches before it. These are summed within parts of TOGETHER matches, then over the
    parts, as one running array over all matches would be copied for each of them.
    """
    regex = F.lit(rule.regex)
    matches, gaps, kept = F.regexp_extract_all(text, regex, F.lit(0)), F.split(text, rule.regex, -1), F.regexp_extract_all(text, regex, F.lit(rule.group))
    pairs = F.arrays_zip(F.transform(matches, lambda m: F.length(m)).alias("n"), F.slice(F.transform(gaps, lambda g: F.length(g)), F.lit(1), F.size(matches)).alias("gap"), F.transform(kept, lambda g: F.length(g)).alias("held"))
    spots = F.array().cast("array<struct<start:int,o:int,end:int,kind:string>>")

    def within(part: Column) -> Column:
        def step(acc: Column, p: Column) -> Column:
            begin = acc["at"] + p["gap"]
            one = F.struct(begin.alias("start"), F.lit(order).alias("o"), (begin + p["n"]).alias("end"), F.lit(rule.kind).alias("kind"))
            return F.struct((begin + p["n"]).alias("at"), F.when(p["held"] >= rule.least, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(part, F.struct(F.lit(0).alias("at"), spots.alias("out")), step)

    def over(acc: Column, part: Column) -> Column:
        return F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["from"], F.array(acc["at"])).alias("from"))

    def moved(done: Column) -> Column:
        begins = F.aggregate(done, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("from")), over, lambda acc: acc["from"])
        return F.flatten(F.zip_with(done, begins, lambda part, at: F.transform(part["out"], lambda s: F.struct((s["start"] + at).alias("start"), s["o"].alias("o"), (s["end"] + at).alias("end"), s["kind"].alias("kind")))))

    def in_parts(all_pairs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(all_pairs) - 1), F.lit(TOGETHER)), lambda k: within(F.slice(all_pairs, k + 1, F.lit(TOGETHER))))

    return _bound(_bound(pairs, in_parts), moved)


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scan(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """docs with a column secret_spans, sorted by start, then kind as listed."""
    key, kinds = unused(docs, "key"), unused(docs, "kinds")
    found = settle(candidates(postings(docs, rules, text), rules).select(F.col("key").alias(key), F.col("kinds").alias(kinds)), "secret-candidates")
    none = F.array().cast("array<struct<start:int,o:int,end:int,kind:string>>")
    t, each = F.col(text), []
    for k, rule in enumerate(rules):
        may = F.array_contains(kinds, rule.kind) if trigram_query(rule.pattern) else t.rlike(rule.regex)
        each.append(F.when(may, _spans(t, rule, k)).otherwise(none))
    joined = docs.withColumn(key, text_key(t)).join(found, key, "left")
    return joined.withColumn("secret_spans", F.array_sort(F.concat(*each))).drop(key, kinds)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    spans = F.col("secret_spans")
    counts = [F.size(F.filter(spans, _of_kind(r.kind))).cast("long").alias(f"n_{r.kind}") for r in RULES if r.base]
    base = F.filter(spans, lambda s: s["kind"].isin([r.kind for r in RULES if r.base]))
    return found.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(spans).alias("spans"))


def _oracle() -> str:
    kinds = " UNION ALL ".join(
        f"""SELECT r, {k} AS o, '{rule.kind}' AS kind, {rule.base} AS base, {rule.least} AS least,
        regexp_extract_all(t, '{rule.regex.replace("'", "''")}', 0) AS ms, regexp_extract_all(t, '{rule.regex.replace("'", "''")}', {rule.group}) AS gs, string_split_regex(t, '{rule.regex.replace("'", "''")}') AS ps FROM d"""
        for k, rule in enumerate(RULES)
    )
    count = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in RULES if r.base)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    m AS ({kinds}),
    u AS (SELECT r, o, kind, base, least, ms, gs, ps, unnest(generate_series(1, len(ms))) AS i FROM m WHERE len(ms) > 0),
    s AS (SELECT r, o, kind, base, list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS st, length(ms[i]) AS n
          FROM u WHERE length(gs[i]) >= least),
    a AS (SELECT r, {count},
          coalesce(string_agg(kind || ':' || st || ':' || (st + n), ',' ORDER BY st, o) FILTER (base), '') AS b,
          string_agg(kind || ':' || st || ':' || (st + n), ',' ORDER BY st, o) AS spans FROM s GROUP BY r)
    SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES if r.base)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN a USING (r)"""


ORACLE = {"op2_secrets": _oracle()}
