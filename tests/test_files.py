import json
import os

import numpy as np
import pytest

from tessella.operators import feedback as B
from tessella.sources import readers
from tessella.streaming import feedback as S


def bmp(a):
    h, w = a.shape
    row = (w * 8 + 31) // 32 * 4
    body = b"".join(bytes(r.astype(np.uint8)) + bytes(row - w) for r in a[::-1])
    head = b"BM" + (1078 + len(body)).to_bytes(4, "little") + bytes(4) + (1078).to_bytes(4, "little") + (40).to_bytes(4, "little") + w.to_bytes(4, "little") + h.to_bytes(4, "little") + (1).to_bytes(2, "little") + (8).to_bytes(2, "little") + bytes(24)
    return head + bytes(1024) + body


@pytest.fixture
def images(tmp_path):
    a = np.zeros((4, 6))
    a[1, 2] = 255
    (tmp_path / "set").mkdir()
    (tmp_path / "set" / "My Font Bold Au.bmp").write_bytes(bmp(a))
    (tmp_path / "set" / "My Font Bold bl.bmp").write_bytes(b"broken")
    return str(tmp_path)


def test_glyph_files_and_images(spark, images):
    g = {(r.font, r.letter, r.case, r.source) for r in readers.glyph_files(spark, images, "std").collect()}
    assert g == {("My Font Bold", "a", "u", "std"), ("My Font Bold", "b", "l", "std")}
    got = {r.path.endswith("Au.bmp"): r for r in readers.load_images(spark, images).collect()}
    assert got[False].pixels is None and (got[True].h, got[True].w) == (4, 6)
    assert got[True].pixels[8] == 1.0 and sum(got[True].pixels) == 1.0
    sdf = [r.sdf for r in readers.signed_distance(readers.load_images(spark, images)).collect() if r.pixels]
    assert sdf[0][8] == pytest.approx(-1 / 6) and sdf[0][9] == pytest.approx(1 / 6)
    m = [r for r in readers.market_normalised(readers.load_images(spark, images), 16, 4).collect() if r.pixels]
    assert len(m[0].pixels) == 256


def test_descriptions(spark, tmp_path):
    (tmp_path / "c.csv").write_text("base_font_name,category,theme\na,x,y\nb,x,y,z,w\na,p,q\n")
    got = {r.key: r.adjectives for r in readers.category_csv(spark, str(tmp_path / "c.csv")).collect()}
    assert got["a"] == ["p", "q"]
    (tmp_path / "f.csv").write_text("family,na,tags,weight\nA,,/x/y/bold,50\nA,,thin,10\n")
    rows = {(r.family, r.tag, r.weight) for r in readers.family_csv(spark, str(tmp_path / "f.csv")).collect()}
    assert rows == {("A", "bold", 0.5), ("A", "thin", 0.1)}
    for d, marked in (("one", True), ("two", False)):
        os.makedirs(tmp_path / "art" / d / "article")
        (tmp_path / "art" / d / "a.html").write_text("<p>Hello&amp;<script>x()</script> <b>world</b></p>")
        if marked:
            (tmp_path / "art" / d / "METADATA.pb").write_text("name")
    got = readers.articles(spark, str(tmp_path / "art")).collect()
    assert len(got) == 1 and got[0].folder.endswith("one") and got[0].text == "Hello& world"
    (tmp_path / "v.json").write_text('{"f": [1, 2.5]}')
    assert readers.vector_json(spark, str(tmp_path / "v.json")).first().v == [1.0, 2.5]
    with pytest.raises(ValueError):
        readers.save_twice(got and spark.range(1), str(tmp_path), "../x")
    readers.save_twice(spark.range(3), str(tmp_path / "s"), "2024-01-01 10-00")
    assert spark.read.parquet(str(tmp_path / "s" / "latest")).count() == 3


def test_articles_are_not_gathered(spark, tmp_path):
    """The last file is chosen by its name; pages aren't aggregated, and lines that markup runs over are read in order."""
    for d, names in (("a b", ("1.html", "2.html", "note.pb")), ("c", ("9.html", "METADATA.pb")), ("d", ("x.html",))):
        os.makedirs(tmp_path / d)
        for n in names:
            (tmp_path / d / n).write_text(f"<p>{d}\n<script>\nx</script \n>{n}</p\n>\n")
    got = readers.articles(spark, str(tmp_path), ".pb")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in plan and "value" not in "".join(x for x in plan.splitlines() if "Aggregate" in x)
    assert {(r.folder.rsplit("/", 1)[1], r.text) for r in got.collect()} == {("a b", "a b 2.html"), ("c", "c 9.html")}


def test_approvals_and_ring(spark):
    log = spark.createDataFrame([(1, 1, "q", "add", 1), (1, 1, "q", "remove", 2), (1, 2, "q", "add", 3), (2, 1, "q", "remove", 4), (2, 1, "q", "add", 5)], "font int, user int, query string, op string, seq int")
    assert {(r.font, r.user) for r in B.approvals(log).collect()} == {(1, 2), (2, 1)}
    later = log.union(spark.createDataFrame([(1, 9, "z", "remove", 9)], log.schema))
    assert {(r.font, r.user) for r in B.approvals(later, "font").collect()} == {(2, 1)}
    assert sorted((r.id, r.slot) for r in B.ring(spark.range(10), 4, "id").collect()) == [(6, 2), (7, 3), (8, 0), (9, 1)]
    assert B.ring(spark.range(2), 4, "id").count() == 2


def test_streams(spark, tmp_path):
    e = spark.range(100).selectExpr("id AS event_id", "timestamp_seconds(1700000000 + id * 600) AS ts", "id % 3 AS user_id", "'x' AS event_type", "double(id) AS value", "'{}' AS props")
    e.write.parquet(str(tmp_path / "in"))
    out = S.run_available(S.limit_stream(S.event_stream(spark, str(tmp_path / "in")), "user_id", "1 hour", 1), str(tmp_path / "o"), str(tmp_path / "c"))
    batch = B.over_limit(e, "user_id", "1 hour", 1)
    assert 0 < out.count() <= batch.count() and out.exceptAll(batch.select(out.columns)).isEmpty()
    args = (["user_id"], "value", ["event_id"], str(tmp_path / "s"), str(tmp_path / "c2"))
    S.upsert_stream(S.event_stream(spark, str(tmp_path / "in")), *args)
    e.where("event_id < 2").selectExpr("event_id + 500 AS event_id", "ts", "user_id", "event_type", "value", "props").write.mode("append").parquet(str(tmp_path / "in"))
    S.upsert_stream(S.event_stream(spark, str(tmp_path / "in")), *args)
    got = {r.user_id: r.event_id for r in spark.read.parquet(str(tmp_path / "s" / "1")).collect()}
    assert got == {0: 500, 1: 501, 2: 98}
    q = S.ring_stream(S.event_stream(spark, str(tmp_path / "in")), "user_id", "value", 3).writeStream.format("memory").queryName("rings").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c3")).start()
    q.awaitTermination()
    assert all(len(r["items"]) == 3 for r in spark.sql("SELECT * FROM rings").collect())


def png(px, depth, kind, laced=False, extra=b"", filters=(0, 1, 2, 3, 4)):
    """A PNG file of samples (h, w, n), written apart from the reader: every filter is used in turn."""
    import struct
    import zlib

    def part(t, d):
        return struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))

    def lines(a):
        out, back = b"", max(1, a.shape[2] * depth // 8)
        last = None
        for y, row in enumerate(a.reshape(len(a), -1)):
            if depth == 16:
                raw = b"".join(int(v).to_bytes(2, "big") for v in row)
            else:
                bits = "".join(format(int(v), f"0{depth}b") for v in row)
                raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
            last, f, line = last or bytes(len(raw)), filters[y % len(filters)], bytearray()
            for x, v in enumerate(raw):
                l, u, c = raw[x - back] if x >= back else 0, last[x], last[x - back] if x >= back else 0
                e = l + u - c
                paeth = min((abs(e - l), 0, l), (abs(e - u), 1, u), (abs(e - c), 2, c))[2]
                line.append((v - (0, l, u, (l + u) // 2, paeth)[f]) & 255)
            out, last = out + bytes([f]) + bytes(line), raw
        return out

    h, w, _ = px.shape
    passes = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
    data = b"".join(lines(px[y::dy, x::dx]) for x, y, dx, dy in passes if px[y::dy, x::dx].size) if laced else lines(px)
    z = zlib.compress(data)
    head = struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, laced)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + extra + part(b"IDAT", z[:7]) + part(b"IDAT", z[7:]) + part(b"IEND", b"")


@pytest.mark.parametrize("laced", [False, True])
@pytest.mark.parametrize("kind,depth", [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 4), (3, 8), (4, 8), (4, 16), (6, 8), (6, 16)])
def test_png(kind, depth, laced):
    import struct
    import zlib

    from tessella.sources.png import grey

    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    r = np.random.default_rng(depth + kind)
    for h, w in ((11, 13), (1, 1), (3, 9)):
        px = r.integers(0, min(2**depth, 16 if kind == 3 else 2**depth), (h, w, n))
        palette = r.integers(0, 256, (16, 3))
        body = b"PLTE" + bytes(palette.astype(np.uint8).ravel())
        extra = struct.pack(">I", 48) + body + struct.pack(">I", zlib.crc32(body)) if kind == 3 else b""
        rgb = palette[px[:, :, 0]] / 255 if kind == 3 else px / (2**depth - 1)
        want = rgb[:, :, :3] @ [0.299, 0.587, 0.114] if kind in (2, 3, 6) else rgb[:, :, 0]
        raw = png(px, depth, kind, laced, extra)
        assert np.allclose(grey(raw), want)
        for bad in (raw[:-5], raw[:40], raw[:45] + bytes([raw[45] ^ 1]) + raw[46:], b"\x89PNG\r\n\x1a\n"):
            with pytest.raises(ValueError):
                grey(bad)


def test_market_files_are_converted_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "Font_aa.png").write_bytes(png(np.tile(np.arange(10) * 25, (10, 1))[:, :, None], 8, 0))
    (tmp_path / "in" / "Font_b.png").write_bytes(b"broken")
    out = readers.converted(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    got = {os.path.basename(r.path): r.pixels for r in out.collect()}
    assert len(got["Font_aa.png"]) == 48 * 48 and got["Font_b.png"] is None
    (tmp_path / "in" / "Font_c.png").write_bytes(b"")
    assert readers.converted(spark, str(tmp_path / "in"), str(tmp_path / "out")).count() == 2


def test_json_lists_are_read_by_pieces(spark, tmp_path):
    odd = {"a]b": ["x]", "]", "\\", 'c"]', "{", "}"], "b": [], "é \\": ["]]", 'plain, "quoted"'], "}": ["}"], "last": ["z"]}
    for name, text in (("one", json.dumps(odd)), ("wide", json.dumps(odd, indent=2, ensure_ascii=False) + "\n"), ("none", "{}"), ("empty", ""), ("plain", '{"n": null, "k": ["v", "w"], "m": null}')):
        (tmp_path / f"{name}.json").write_text(text)
        want = sorted((k, v) for k, vs in (json.loads(text) if text else {}).items() for v in vs or [])
        assert sorted(map(tuple, readers.query_json(spark, str(tmp_path / f"{name}.json")).collect())) == want, name
    (tmp_path / "v.json").write_text('{"n": null, "k": [1, 2.5], "m": null}')
    assert [tuple(r) for r in readers.vector_json(spark, str(tmp_path / "v.json")).collect()] == [("n", None), ("k", [1.0, 2.5]), ("m", None)]


def test_one_json_file_is_read_by_several_tasks(spark, tmp_path):
    many = {f"k{k}": [k / 8, -k, 1e-9] for k in range(20_000)}
    odd = {f"k{k}": ["]" * (k % 3), f'"{k}]', "a" * (k % 50)] for k in range(20_000)}
    (tmp_path / "v.json").write_text(json.dumps(many))
    (tmp_path / "q.json").write_text(json.dumps(odd))
    old = {n: spark.conf.get(n) for n in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 65536)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        v = readers.vector_json(spark, str(tmp_path / "v.json"))
        assert v.rdd.getNumPartitions() > 5 and {r.font: r.v for r in v.collect()} == many
        assert sorted(map(tuple, readers.query_json(spark, str(tmp_path / "q.json")).collect())) == sorted((k, x) for k, xs in odd.items() for x in xs)
    finally:
        for n, x in old.items():
            spark.conf.set(n, x)


def test_the_last_row_over_several_csv_files_counts(spark, tmp_path):
    for k, name in enumerate("cab"):
        (tmp_path / f"{name}.csv").write_text("base_font_name,category,theme\n" + f"x,{name},1\n" * (400 if name != "c" else 1) + f"x,{name},2\n{name},own,{k}\n")
    got = {r.key: r.adjectives for r in readers.category_csv(spark, str(tmp_path)).collect()}
    assert got == {"x": ["c", "2"], "c": ["own", "0"], "a": ["own", "1"], "b": ["own", "2"]}


def test_vectors_keep_their_values_in_json(spark, tmp_path):
    """Singles just beside half of a fifth place: their shortest digits are that half."""
    import duckdb
    import numpy as np

    from tessella.plans import files

    x = [float(np.float32(k / 1e6)) for k in range(5, 200_000, 10) if str(np.float32(k / 1e6)) == str(k / 1e6) and float(np.float32(k / 1e6)) < k / 1e6][:50]
    rows = [(k, [v, -v]) for k, v in enumerate(x)]
    assert len(rows) == 50
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        want = c.execute(files.ORACLE["vector_json_scan"]).fetchall()
    assert sorted(tuple(r) for r in files.vector_json_scan(spark, str(tmp_path)).collect()) == sorted(want)
