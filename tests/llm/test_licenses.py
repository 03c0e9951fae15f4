import random
import re

from tessella.llm import licenses as L


def test_every_template_is_found_where_it_stands():
    r = random.Random(1)
    noise = lambda n: " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(n))
    for name, text in L.TEMPLATES.items():
        for before, after in ((0, 0), (300, 5), (3, 2000)):
            whole = f"{noise(before)} é🎉 \n{text}\n{noise(after)}"
            got = L.find(whole)
            assert [x["license"] for x in got] == [name], (name, got)
            assert whole[got[0]["start"] : got[0]["end"]] == text and got[0]["lacking"] == got[0]["extra"] == []


def test_differences():
    t = L.TEMPLATES["Apache-2.0/notice"]
    assert L.find(t.replace("2.0", "1.1")) == []
    assert L.find("Licensed under the Foo License, Version 2.0.") == []
    assert L.find("the license of a driver") == L.find("") == L.find(None) == []
    mit = L.TEMPLATES["MIT"].replace("hereby granted", "granted").replace("any person", "any nice person")
    (x,) = L.find(mit)
    assert x["license"] == "MIT" and x["lacking"] == ["hereby"] and x["extra"] == ["nice"]
    assert L.find(L.TEMPLATES["MIT"].replace("without restriction", "with restriction")) == []
    two = f"{t}\nsome words\n{L.TEMPLATES['MIT/notice']}"
    assert [x["license"] for x in L.find(two)] == ["Apache-2.0/notice", "MIT/notice"]
    L.find("license " * 20_000)
    assert L.gains("released under the mit license".split())[0][1] == 0


def test_rows_and_query(spark, sf):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "x", 3), (3, L.TEMPLATES["BSD"], 4), (3, L.TEMPLATES["BSD"], 4)], "doc_id long, text string, licenses int")
    assert sorted(len(r.licenses) for r in L.scan(df).collect()) == [0, 0, 0, 1, 1]
    assert L.scan(df.limit(0)).count() == 0
    notices = [n for n in L.TEMPLATES if n.endswith("/notice")]
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    seen = 0
    for r in L.op8_licenses(spark, "/root/testdata/sf0.01").collect():
        want = sorted((m.start(), f"{n}:{m.start()}:{m.end()}") for n in notices for m in re.finditer(re.escape(L.TEMPLATES[n]), texts[r.doc_id]))
        got = [] if not r.spans else r.spans.split(",")
        assert set(x for _, x in want) <= set(got), r.doc_id
        seen += len(want)
    assert seen > 20


def exact(text):
    """Every place where a template's words stand one after another; of places that overlap, the longest."""
    words = [(p, m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text) if (p := m[0].strip(".,;:!?\"'()[]<>*#$%&/").lower())]
    plain, hits = [w for w, _, _ in words], []
    for name, template in L.TEMPLATES.items():
        t = [p for w in template.split() if (p := w.strip(".,;:!?\"'()[]<>*#$%&/").lower())]
        hits += [(len(t), k, name) for k in range(len(plain) - len(t) + 1) if plain[k : k + len(t)] == t]
    out, taken = [], set()
    for n, k, name in sorted(hits, key=lambda x: (-x[0], x[1])):
        if not taken & set(range(k, k + n)):
            taken |= set(range(k, k + n))
            out.append((words[k][1], name, words[k + n - 1][2]))
    return sorted(out)


def test_query_as_brute_force(spark):
    """The query's spans are those of a plain search, no more and no fewer."""
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {d: ",".join(f"{n}:{a}:{b}" for a, n, b in exact(t)) if L._HINT.search(t) else "" for d, t in texts.items()}
    assert {r.doc_id: r.spans for r in L.op8_licenses(spark, sf).collect()} == want


def test_ranking_chooses_among_like_templates():
    r = random.Random(6)
    words = lambda n: " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(n))
    for name, template in L.TEMPLATES.items():
        t = template.split()
        if len(t) < 20:
            continue
        for _ in range(5):
            edited = list(t)
            spots = [k for k in range(2, len(t) - 2) if not L._weighty(L._plain(t[k]))]
            for k in sorted(r.sample(spots, max(1, len(t) // 30)), reverse=True):
                edited[k : k + 1] = r.choice([[], [t[k], "extra"], ["other"]])
            text = f"{words(r.choice([0, 40, 400]))} {' '.join(edited)} {words(40)}"
            assert [x["license"] for x in L.find(text)] == [name]
    both = f"{L.TEMPLATES['GPL-2.0+']} {words(10)} {L.TEMPLATES['GPL-3.0+']} {words(10)} {L.TEMPLATES['SPDX/BSD-3-Clause']} {L.TEMPLATES['SPDX/MIT']}"
    assert [x["license"] for x in L.find(both)] == ["GPL-2.0+", "GPL-3.0+", "SPDX/BSD-3-Clause", "SPDX/MIT"]


def test_a_long_block_has_each_notice_once():
    """A notice at any offset of a block that is read in parts."""
    for name in ("MIT", "GPL-3.0+", "BSD"):
        template = next(t[1] for t in L._templates() if t[0] == name)
        for offset in range(0, 400, 2):
            filler = [("license" if k % 60 == 0 else f"w{k}") for k in range(900)]
            text = " ".join(filler[:offset] + template + filler[offset:])
            found = [x["license"] for x in L.find(text)]
            assert found == [name], (name, offset, found)
