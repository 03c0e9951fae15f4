import random

from pyspark.sql import functions as F

from tessella.llm import urls as U


def test_parse_and_rules(spark):
    rows = [
        (1, "http://A.Example.COM/en/7x?q#f", "a.example.com", "/en/7x", "example.com/en/7", "allow"),
        (2, "https://example.com/en/6", "example.com", "/en/6", "com/en/", "block"),
        (3, "x://b.net/de/8", "b.net", "/de/8", "net/de/", "allow"),
        (4, "x://example.net/de/81", "example.net", "/de/81", "example.net/de/8", "block"),
        (5, "x://notexample.net/de/81", "notexample.net", "/de/81", "net/de/", "allow"),
        (6, "x://org?/es/", "org", "", None, "allow"),
        (7, "no scheme", "", "", None, "allow"),
        (8, None, "", "", None, "allow"),
        (9, "x://É.org/es/://y", "É.org", "/es/://y", "org/es/", "block"),
        (9, "x://É.org/es/://y", "É.org", "/es/://y", "org/es/", "block"),
        (10, "", "", "", None, "allow"),
        (None, "a://b#://c/d", "b", "", None, "allow"),
        (11, "h://d.example.net/" + "s/" * 30, "d.example.net", "/" + "s/" * 30, None, "allow"),
    ]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b, *_ in rows], "page_id long, url string, html string, template int").withColumn("rule", F.lit(1))
    assert sorted(U.judged(df).columns) == sorted(["page_id", "url", "html", "host", "path", "rule", "template", "purity", "verdict"])
    got = sorted((tuple(r) for r in U.judged(df).select("page_id", "url", "host", "path", "rule", "verdict").collect()), key=str)
    assert got == sorted(rows, key=str)
    assert U.judged(df.limit(0)).count() == 0


def test_templates(spark):
    r = random.Random(1)
    rules = [U.UrlRule("block", "s.com", f"/bad/{d}") for d in "123456789"] + [U.UrlRule("allow", "s.com", "/good/")]
    urls = [f"h://s.com/bad/{r.randint(0, 10**6)}/x" for _ in range(400)] + [f"h://s.com/good/{k}/x" for k in range(300)] + ["h://s.com/bad/00/x", "h://s.com/other/1/x"]
    got = {x.url: x for x in U.judged(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()}
    bad, good = got["h://s.com/bad/00/x"], got["h://s.com/good/5/x"]
    assert bad.rule is None and bad.verdict == "block" and bad.template.startswith("/~+/*")
    assert good.verdict == "allow" and good.template.startswith("/~-/*")
    assert got["h://s.com/other/1/x"].verdict == "allow"


def test_planted_spam_paths(spark):
    """Urls without a rule, judged by branches of their own host and by shapes that other hosts share."""
    r = random.Random(3)
    rules = [U.UrlRule("block", f"h{k}.com", "/casino/1") for k in range(4)] + [U.UrlRule("allow", f"h{k}.com", "/news/1") for k in range(4)]
    at = lambda host, part, lead: f"http://{host}.com/{part}/{lead}{r.randint(1000, 9999)}"
    urls = [at(f"h{k}", part, lead) for k in range(4) for part in ("casino", "news", "blog") for lead in "12" for _ in range(40)]
    urls += [at("other", part, 5) for part in ("casino", "news", "blog") for _ in range(30)] + ["http://lone.com/casino/17", "http://lone.com/casino/page", "http://lone.com/2024-05-06/x.html"]
    df = spark.createDataFrame([(u, 1, 2) for u in urls], "url string, label int, blocked int")
    got = U.judged(df, rules, evidence=True).collect()
    assert len(got) == len(urls) and all(x.label == 1 and x.blocked == 2 for x in got)
    for x in got:
        part = x.path.split("/")[1]
        own = "rule" if x.path.split("/")[2].startswith("1") and x.host.startswith("h") else "branch"
        if x.host.startswith("h"):
            want = ("block" if part == "casino" else "allow", own if part != "blog" else "none")
        elif x.host == "other.com":
            want = ("block" if part == "casino" else "allow", "none" if part == "blog" else "shape")
        else:
            want = ("allow", "none")  # few siblings: their segments stay as they are
        if part == "blog":
            want = ("allow", "none")
        assert (x.verdict, x.evidence) == want, (x.url, x.verdict, x.evidence)


def test_merged_branches(spark):
    """Branches whose shares of blocked urls are alike become one; those apart stay apart."""
    share = {"a": 0.0, "b": 0.02, "c": 0.5, "d": 0.55, "e": 1.0}
    rules = [U.UrlRule("block", "m.com", f"/{s}/bad") for s in share] + [U.UrlRule("allow", "m.com", f"/{s}/ok") for s in share]
    urls = [(f"x://m.com/{s}/{'bad' if k < 100 * p else 'ok'}",) for s, p in share.items() for k in range(100)]
    got = {x.path.split("/")[1]: x.template.split("/")[1] for x in U.judged(spark.createDataFrame(urls, "url string"), rules).collect()}
    assert got == {"a": "~-", "b": "~-", "c": "~1", "d": "~1", "e": "~+"}
