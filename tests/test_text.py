"""Article text by states, and counts of earlier smaller losses."""

import random
from html.parser import HTMLParser

import pytest

from tessella.functions import text as X
from tessella.operators import feedback


class Words(HTMLParser):
    """What the standard parser takes for text, scripts and styles left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.raw = [], 0

    def handle_starttag(self, tag, attrs):
        self.raw += tag in ("script", "style")
        self.out.append(" ")

    def handle_endtag(self, tag):
        self.raw -= tag in ("script", "style")
        self.out.append(" ")

    def handle_comment(self, data):
        self.out.append(" ")

    handle_decl = handle_pi = handle_comment

    def handle_startendtag(self, tag, attrs):
        self.out.append(" ")

    def handle_data(self, data):
        if not self.raw:
            self.out.append(data)


def parsed(page):
    p = Words()
    p.feed(page)
    p.close()
    return " ".join("".join(p.out).replace("\xa0", " ").split())


PAGES = [
    "", "plain", "<!-- a > b -->text", '<a title="x > y">link</a>', "if a < b and c > d", "&eacute; &#8217; &mdash; &#x41; &amp;lt; &nbsp;x", "<p>one<br/>two</p>three",
    "<script>if (a < b) { '<p>' }</script>after<style type='text/css'>p > a {}</style>.", "<!DOCTYPE html><?xml version='1'?><b>x</b>", "<a href='it\"s > fine'>quoted</a>", "a<b", "5 < 6 > 4",
    "&copy 2024 &notit; &bogus; &#0; AT&T", "<SCRIPT>x</SCRIPT >y", "<td\nclass=a\n>cell</td>", "<!-- one --> -- <!-- two\n-->end", "x" * 50_000 + "<i>" + "y" * 50_000 + "</i>",
]


def test_states(spark):
    got = [r.t for r in spark.createDataFrame([(k, p) for k, p in enumerate([*PAGES, None])], "k int, p string").select("k", X.html_text("p").alias("t")).orderBy("k").collect()]
    assert got == [*map(parsed, PAGES), None]


def test_given_pages(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("html", X.html_text("html").alias("t")).collect()
    assert all(r.t == parsed(r.html) for r in rows)


@pytest.mark.parametrize("chunk, n", [(8, 700), (64, 3000), (4096, 500)])
def test_earlier_smaller_losses(spark, monkeypatch, chunk, n):
    monkeypatch.setattr(feedback, "CHUNK", chunk)
    monkeypatch.setattr(feedback.math, "isqrt", lambda n: 0)
    r = random.Random(chunk)
    rows = [(r.choice(["a", "a", "a", "b", None]), k, r.choice([None, 0.5, round(r.random(), 2), round(r.random(), 2)])) for k in range(n)]
    r.shuffle(rows)
    got = feedback.early_stop(spark.createDataFrame(rows, "run string, day long, loss double"), "run", "day", "loss").collect()
    want = []
    for g in ("a", "b", None):
        before = []
        for _, k, x in sorted(x for x in rows if x[0] == g):
            c = sum(y < x for y in before) if x is not None else 0
            want.append((g, k, x, c, c >= 2))
            before += [] if x is None else [x]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_one_long_run(spark):
    n = 200_000
    df = spark.range(n).selectExpr("'r' AS run", "id AS day", f"cast((id * 7919) % {n} as double) AS loss")
    got = feedback.early_stop(df, "run", "day", "loss").selectExpr("sum(better_before) AS s", "count(*) AS n").first()
    import numpy as np

    values, total, seen = (np.arange(n) * 7919) % n, 0, np.empty(0, np.int64)
    for k in range(0, n, 5000):  # earlier blocks by a sorted array, the own block pair by pair
        block = values[k : k + 5000]
        total += int(np.searchsorted(seen, block).sum()) + int(np.triu(block[:, None] < block[None, :], 1).sum())
        seen = np.sort(np.concatenate([seen, block]))
    assert (got.s, got.n) == (total, n)


def test_cut_references_stay_in_the_queries(spark, tmp_path):
    """Titles that end within a reference: the queries leave what has no semicolon, as their SQL does; the function reads it as HTML."""
    import duckdb

    from tessella.plans import files

    html = ["<h1>a&amp;&amp</h1><p>b &copy; &quot</p>", "<h1>a&am</h1>&middot;&ampx; &bogus; &amp;lt", "&amp;amp;amp", None]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        for name in ("html_text", "article_scan"):
            got = [tuple(r) for r in getattr(files, name)(spark, str(tmp_path)).collect()]
            assert sorted(got, key=str) == sorted(c.execute(files.ORACLE[name]).fetchall(), key=str)
    assert X.page_text(html[0]) == "a&& b © \"" and X.page_text("&#39;&#x41;&eacute;&eacute", whole=True) == "'Aé&eacute"
