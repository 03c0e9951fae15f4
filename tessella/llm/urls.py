"""URL filters by a path-template tree, with DataFrame operations only.

Each host has a tree of path segments. Level by level, segments that are rare among many siblings become a wildcard of
their type (numbers, numbered files, dates, hex, others). The other siblings that hold labelled urls are ordered by their
smoothed purity, (blocked + 1) / (labelled + 2), and neighbours in that order whose shares of blocked urls don't differ
significantly are merged: into `~` if all are alike, else `~-` (least), `~+` (most), `~1`, `~2`... between them. What a url
comes to is its template; the same with segments in place of merged branches is its shape, which other hosts may share.

A template takes the purity of its deepest branch with labelled urls; without any, that of its shape over all hosts, if
urls of that shape are labelled on at least HOSTS of them. It is rejected if that purity reaches PURITY, else, or without
evidence, allowed. Labels are the verdicts of the rules, which hold for their own urls anyway; so what the tree decides
is the urls without a rule. On request a column `evidence`
tells where a verdict comes from: rule, branch, shape or none.

Null urls and urls without "://" have an empty host and path. Repeated rows weigh as often as they occur. Segments beyond
DEPTH stay together as one. An empty table gives an empty result. Columns of the new ones' names are replaced, all others
pass through whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.common import forget, settle, table, unused

DEPTH, KINDS, RARE, APART, PURITY, HOSTS = 8, 8, 20, 2.0, 0.8, 3
#: Types of variable segments, the first that fits.
TYPES = (("*d", "^[0-9]+$"), ("*f", "^[0-9]+[.][A-Za-z0-9]+$"), ("*t", "^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), ("*x", "^[0-9a-f-]{8,}$"), ("*", ""))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The contract's rules.
RULES = [
    UrlRule("block", "com", "/en/"),
    UrlRule("allow", "example.com", "/en/7"),
    UrlRule("allow", "net", "/de/"),
    UrlRule("block", "example.net", "/de/8"),
    UrlRule("block", "org", "/es/"),
]


def parsed(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host and path; columns of these names are replaced."""
    u = F.col(url)
    rest = F.coalesce(F.when(F.contains(u, F.lit("://")), F.substr(u, F.instr(u, "://") + 3)), F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": F.translate(host, _UPPER, _LOWER), "path": path})


def _rule(rules: list[UrlRule]) -> tuple[Column, Column]:
    """The longest rule that fits host and path, or null, and its verdict."""
    rule, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, label = F.when(fits, F.lit(r.name)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(label)
    return rule, label


def _segments(path: Column) -> Column:
    return F.split(F.regexp_replace(path, "^/", ""), "/", DEPTH)


def _type(segment: Column) -> Column:
    out = F.lit(TYPES[-1][0])
    for name, pattern in reversed(TYPES[:-1]):
        out = F.when(segment.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def _branches(here: DataFrame) -> DataFrame:
    """(host, template, segment, name, plain, branch_labelled, branch_blocked): what each segment of a level becomes.

    A node has at most RARE + KINDS branches besides its wildcards, so the windows are over few rows.
    """
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    nodes = here.groupBy("host", "template", "segment").agg(*sums)
    above = nodes.groupBy("host", "template").agg(F.sum("n").alias("all_n"), F.count("*").alias("kinds"))
    wild = (F.col("kinds") > KINDS) & (F.col("n") * RARE < F.col("all_n"))
    typed = nodes.join(above, ["host", "template"]).withColumn("wild", wild).withColumn("plain", F.when(F.col("wild"), _type(F.col("segment"))).otherwise(F.col("segment")))
    known = ~F.col("wild") & (F.col("labelled") > 0)
    each = typed.groupBy("host", "template", "wild", "plain").agg(*sums).withColumn("known", known)
    order = W.partitionBy("host", "template", "known").orderBy(F.expr("(blocked + 1D) / (labelled + 2D)"), "wild", "plain")
    each = each.withColumn("l", F.lag("labelled").over(order)).withColumn("b", F.lag("blocked").over(order))
    p, rates = "((blocked + b) / CAST(labelled + l AS DOUBLE))", "(blocked / CAST(labelled AS DOUBLE) - b / CAST(l AS DOUBLE))"
    spread = f"({p} * (1D - {p}) * (1D / labelled + 1D / l))"
    cut = F.expr(f"CASE WHEN l IS NULL OR {spread} <= 0D THEN 0 WHEN {rates} / sqrt({spread}) > {APART}D THEN 1 ELSE 0 END")
    each = each.withColumn("cut", F.when(F.col("known"), cut).otherwise(0)).withColumn("group", F.sum("cut").over(order))
    each = each.withColumn("groups", F.max("group").over(W.partitionBy("host", "template", "known")))
    merged = F.expr("CASE WHEN groups = 0 THEN '~' WHEN `group` = 0 THEN '~-' WHEN `group` = groups THEN '~+' ELSE concat('~', `group`) END")
    each = each.withColumn("name", F.when(F.col("known"), merged).otherwise(F.col("plain")))
    total = W.partitionBy("host", "template", "wild", "known", "name")
    each = each.select("host", "template", "wild", "plain", "name", F.sum("labelled").over(total).alias("branch_labelled"), F.sum("blocked").over(total).alias("branch_blocked"))
    return typed.select("host", "template", "wild", "plain", "segment").join(each, ["host", "template", "wild", "plain"]).drop("wild")


def templates(urls: DataFrame) -> DataFrame:
    """(host, path, template, purity, evidence) of labelled urls (host, path, label)."""
    labelled, blocked = F.count("label").alias("labelled"), F.sum((F.coalesce("label", F.lit("")) == "block").cast("long")).alias("blocked")
    start = urls.groupBy("host", "path").agg(F.count("*").alias("n"), labelled, blocked).withColumn("segments", _segments(F.col("path")))
    none = F.lit(0).cast("long")
    now = settle(start.select("*", F.lit("").alias("template"), F.lit("").alias("shape"), none.alias("near_labelled"), none.alias("near_blocked")), "urls")
    for level in range(now.agg(F.max(F.size("segments"))).first()[0] or 0):
        here = now.withColumn("segment", F.get("segments", F.lit(level)))
        found = _branches(here.where("segment IS NOT NULL"))
        on = F.col("name").isNotNull()
        longer = lambda old, new: F.when(on, F.concat(old, F.lit("/"), new)).otherwise(F.col(old)).alias(old)
        nearer = lambda what: F.when(F.col("branch_labelled") > 0, F.col(f"branch_{what}")).otherwise(F.col(f"near_{what}")).alias(f"near_{what}")
        after = here.join(found, ["host", "template", "segment"], "left")
        before, now = now, settle(after.select("host", "path", "n", "labelled", "blocked", "segments", longer("template", "name"), longer("shape", "plain"), nearer("labelled"), nearer("blocked")), "level")
        forget(before)
    by_host = now.where("labelled > 0").groupBy("shape", "host").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    shared = by_host.groupBy("shape").agg(F.count("*").alias("hosts"), F.sum("labelled").alias("shape_labelled"), F.sum("blocked").alias("shape_blocked")).where(F.col("hosts") >= HOSTS)
    both = now.join(shared, "shape", "left")
    evidence = F.when(F.col("near_labelled") > 0, "branch").when(F.col("hosts").isNotNull(), "shape").otherwise("none")
    purity = F.expr("CASE WHEN near_labelled > 0 THEN (near_blocked + 1D) / (near_labelled + 2D) WHEN hosts IS NOT NULL THEN (shape_blocked + 1D) / (shape_labelled + 2D) ELSE 0.5D END")
    return both.select("host", "path", "template", purity.alias("purity"), evidence.alias("evidence"))


def judged(pages: DataFrame, rules: list[UrlRule] = RULES, url: str = "url", evidence: bool = False) -> DataFrame:
    """pages with host, path, rule, template, purity and verdict; and evidence, if asked for."""
    new = ["host", "path", "rule", "template", "purity", *["evidence"] * evidence, "verdict"]
    keep = [c for c in pages.columns if c not in new]
    label = unused(pages, "label")
    rule, verdict = _rule(rules)
    rows = parsed(pages.select(keep), url).withColumns({"rule": rule, label: verdict})
    found = templates(rows.select("host", "path", F.col(label).alias("label")))
    out = rows.join(found if evidence else found.drop("evidence"), ["host", "path"])
    if evidence:
        out = out.withColumn("evidence", F.when(F.col(label).isNotNull(), "rule").otherwise(F.col("evidence")))
    out = out.withColumn("verdict", F.coalesce(label, F.when(F.col("purity") >= PURITY, "block").otherwise("allow")))
    return out.select(*keep, *new)


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select("page_id", "url"), evidence=True).select("page_id", "host", "path", "rule", "verdict", "evidence")


def _oracle() -> str:
    cases = lambda what: "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{what(r)}'" for r in sorted(RULES, key=lambda r: -len(r.name))) + " END"
    kind = "CASE " + " ".join(f"WHEN regexp_matches(segment, '{pattern}') THEN '{name}'" for name, pattern in TYPES[:-1]) + f" ELSE '{TYPES[-1][0]}' END"
    p, rates = "((blocked + b) / (labelled + l)::DOUBLE)", "(blocked / labelled::DOUBLE - b / l::DOUBLE)"
    spread = f"({p} * (1.0::DOUBLE - {p}) * (1.0::DOUBLE / labelled + 1.0::DOUBLE / l))"
    levels = ""
    for k in range(DEPTH):
        levels += f""",
    n{k} AS (SELECT host, template, segments[{k + 1}] AS segment, sum(n) AS n, sum(labelled)::BIGINT AS labelled, sum(blocked)::BIGINT AS blocked FROM t{k} WHERE len(segments) > {k} GROUP BY ALL),
    a{k} AS (SELECT *, kinds > {KINDS} AND n * {RARE} < all_n AS wild, CASE WHEN kinds > {KINDS} AND n * {RARE} < all_n THEN {kind} ELSE segment END AS plain
        FROM (SELECT *, sum(n) OVER w AS all_n, count(*) OVER w AS kinds FROM n{k} WINDOW w AS (PARTITION BY host, template))),
    e{k} AS (SELECT *, lag(labelled) OVER w AS l, lag(blocked) OVER w AS b FROM (SELECT *, NOT wild AND labelled > 0 AS known FROM (SELECT host, template, wild, plain, sum(labelled)::BIGINT AS labelled, sum(blocked)::BIGINT AS blocked FROM a{k} GROUP BY host, template, wild, plain))
        WINDOW w AS (PARTITION BY host, template, known ORDER BY (blocked + 1.0::DOUBLE) / (labelled + 2.0::DOUBLE), wild, plain)),
    c{k} AS (SELECT *, sum(CASE WHEN NOT known OR l IS NULL THEN 0 WHEN {spread} <= 0 THEN 0 WHEN {rates} / sqrt({spread}) > {APART} THEN 1 ELSE 0 END)
        OVER (PARTITION BY host, template, known ORDER BY (blocked + 1.0::DOUBLE) / (labelled + 2.0::DOUBLE), wild, plain ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM e{k}),
    m{k} AS (SELECT *, CASE WHEN NOT known THEN plain WHEN gs = 0 THEN '~' WHEN g = 0 THEN '~-' WHEN g = gs THEN '~+' ELSE '~' || g::BIGINT END AS name FROM (SELECT *, max(g) OVER (PARTITION BY host, template, known) AS gs FROM c{k})),
    s{k} AS (SELECT *, sum(labelled) OVER w AS bl, sum(blocked) OVER w AS bb FROM m{k} WINDOW w AS (PARTITION BY host, template, wild, known, name)),
    f{k} AS (SELECT a.host, a.template, segment, name, plain, bl, bb FROM a{k} a JOIN s{k} s USING (host, template, wild, plain)),
    t{k + 1} AS (SELECT t.host, path, n, labelled, blocked, segments, t.template || coalesce('/' || name, '') AS template, shape || coalesce('/' || plain, '') AS shape,
        CASE WHEN bl > 0 THEN bl ELSE near_l END AS near_l, CASE WHEN bl > 0 THEN bb ELSE near_b END AS near_b
        FROM t{k} t LEFT JOIN f{k} f ON t.host = f.host AND t.template = f.template AND t.segments[{k + 1}] = f.segment)"""
    return f"""
    WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM a),
    c AS (SELECT *, {cases(lambda r: r.name)} AS rule, {cases(lambda r: r.verdict)} AS label FROM b),
    t0 AS (SELECT host, path, count(*) AS n, count(label) AS labelled, count(*) FILTER (label = 'block') AS blocked,
           CASE WHEN len(s) > {DEPTH} THEN list_append(s[1:{DEPTH - 1}], array_to_string(s[{DEPTH}:], '/')) ELSE s END AS segments, '' AS template, '' AS shape, 0 AS near_l, 0 AS near_b
           FROM (SELECT *, string_split(regexp_replace(path, '^/', ''), '/') AS s FROM c) GROUP BY host, path, s){levels},
    h AS (SELECT shape, count(*) AS hosts, sum(labelled) AS labelled, sum(blocked) AS blocked FROM (SELECT shape, host, sum(labelled) AS labelled, sum(blocked) AS blocked FROM t{DEPTH} WHERE labelled > 0 GROUP BY ALL) GROUP BY shape HAVING count(*) >= {HOSTS}),
    v AS (SELECT host, path, CASE WHEN near_l > 0 THEN (near_b + 1.0::DOUBLE) / (near_l + 2.0::DOUBLE) WHEN hosts IS NOT NULL THEN (h.blocked + 1.0::DOUBLE) / (h.labelled + 2.0::DOUBLE) ELSE 0.5 END AS purity,
          CASE WHEN near_l > 0 THEN 'branch' WHEN hosts IS NOT NULL THEN 'shape' ELSE 'none' END AS evidence FROM t{DEPTH} t LEFT JOIN h USING (shape))
    SELECT page_id, host, path, rule, coalesce(label, CASE WHEN purity >= {PURITY} THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN label IS NOT NULL THEN 'rule' ELSE evidence END AS evidence FROM c JOIN v USING (host, path)"""


ORACLE = {"op4_urls": _oracle()}
