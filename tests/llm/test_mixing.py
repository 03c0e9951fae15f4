import hashlib
import random
import re
from collections import Counter, defaultdict

from tessella.llm import mixing as M


def highest_quotients(targets, seats):
    got = Counter()
    for _ in range(seats):
        k = max(range(len(targets)), key=lambda k: (targets[k] / (2 * got[k] + 1), -k))
        got[k] += 1
    return got


def test_quotas_as_seat_by_seat(spark):
    r = random.Random(1)
    for trial in range(4):
        n = r.randint(1, 12)
        sizes = [r.choice([0, 1, 7, r.randint(0, 5000)]) for _ in range(n)]
        src = spark.createDataFrame([(f"s{k:02}" if k < n - 1 else None, v) for k, v in enumerate(sizes)], "source string, source_size long")
        t = M.targets(src)
        got = {x.k: x for x in M.quotas(t, 16).collect()}
        goals = [got[k].target for k in range(n)]
        assert abs(sum(goals) - 1.5 * sum(sizes)) < 1e-6 * (1 + sum(sizes))
        assert all(g <= 2 * s + 1e-9 for g, s in zip(goals, sizes, strict=True))
        free = [g / M.WEIGHTS[k % 3] for k, g in enumerate(goals) if g < 2 * sizes[k]]
        assert not free or max(free) - min(free) < 1e-6 * max(free)
        want = highest_quotients(goals, int(sum(goals) / 16 + 0.5)) if sum(goals) else {}
        assert {k: x.blocks for k, x in got.items() if x.blocks} == dict(want)
        if sum(goals):
            shards = M.shard_quotas(t, 3, 16).collect()
            total = defaultdict(int)
            for x in shards:
                total[x.source] += x.blocks
            assert total == {x.source: x.blocks for x in got.values() if x.blocks}
            seats = int(sum(goals) / 16 + 0.5)
            for s in range(3):
                upto, before = highest_quotients(goals, seats * (s + 1) // 3), highest_quotients(goals, seats * s // 3)
                assert {x.source: x.blocks for x in shards if x.shard == s} == {got[k].source: upto[k] - before[k] for k in upto if upto[k] > before[k]}


def test_query_seat_by_seat(spark, tmp_path):
    """The query's own result: seats given one by one, words dealt one by one round each source's circle."""
    r = random.Random(8)
    rows = [(k, r.choice(["a", "a", "a", "b", "c", None]), r.choice([" w" * r.randint(0, 60), None])) for k in range(150)] + [(3, "b", "two words"), (3, "b", "two words"), (None, "c", "x y z")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = M.op5_mixing(spark, str(tmp_path)).collect()
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    goal = {}
    for x in got:
        goal[next(s for s in names if sum(len((t or "").split()) for _, u, t in rows if u == s) == x.source_size)] = x.target
    goals = [goal[s] for s in names]
    seats = int(sum(goals) / M.BLOCK + 0.5)
    want = Counter()
    for k, s in enumerate(names):
        docs = sorted(((hashlib.md5((M.SEED + str("null" if d is None else d)).encode()).hexdigest(), d is not None, d or 0, len((t or "").split())) for d, u, t in rows if u == s))
        circle = [n for n, doc in enumerate(docs) for _ in range(doc[3])]
        words, at = [Counter() for _ in docs], 0
        for shard in range(M.SHARDS):
            upto = min(highest_quotients(goals, seats * (shard + 1) // M.SHARDS)[k] * M.BLOCK, 2 * len(circle))
            for at in range(at, upto):
                words[circle[at % len(circle)]][shard] += 1
            at = max(at, upto)
        for doc, each in zip(docs, words, strict=True):
            want[doc[2] if doc[1] else None, doc[3], sum(each.values()), ",".join(f"{a}:{b}" for a, b in sorted(each.items()))] += 1
    assert Counter((x.doc_id, x.size, x.taken, x.shards) for x in got) == want


def test_mix(spark):
    r = random.Random(2)
    rows = [(k, r.choice(["a", "a", "a", "b", "c", None]), "w " * r.randint(0, 50), "x") for k in range(400)] + [(5, "a", None, "x"), (7, "b", "one two", "x"), (7, "b", "one two", "x"), (None, "c", "z", "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, target string")
    got = M.mix(M.sized(df)).collect()
    assert len(got) == len(rows) and all(0 <= x.taken <= 2 * x.size for x in got)
    taken, goal = defaultdict(int), {}
    for x in got:
        taken[x.source] += x.taken
        goal[x.source] = x.target
    assert all(abs(taken[s] - goal[s]) <= M.BLOCK for s in goal)
    assert sorted(map(str, M.mix(M.sized(df)).collect())) == sorted(map(str, got))
    assert M.mix(M.sized(df.limit(0))).count() == 0
    odd = M.mix(M.sized(df).withColumnsRenamed({"target": "tokens"}).withColumn("of", M.F.lit(1)).withColumn("before", M.F.lit(2)))
    assert {(x.tokens, x.of, x.before) for x in odd.collect()} == {("x", 1, 2)}


def test_stage_takes_the_words(spark):
    df = spark.createDataFrame([(k, f" a{k}\tb  c\nd e{'x' * k}", "en", f"s{k % 3}", 0) for k in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    plan = {x.doc_id: x for x in M.mix(M.sized(df.select("doc_id", "source", "text")).drop("text"), M.BLOCK).collect()}
    out = M.stage(spark, df, "")
    assert out.columns == df.columns
    words, texts = Counter(), {x.doc_id: x.text for x in df.collect()}
    for x in out.collect():
        words[x.doc_id] += len(re.findall(M.WORD, x.text))
        assert texts[x.doc_id].startswith(x.text) and x.n_chars == len(x.text)
    assert words == Counter({d: x.taken for d, x in plan.items() if x.taken})


def test_stage_keeps_rows_without_an_id(spark):
    df = spark.createDataFrame([(None, "a b c d " * 50, None), (1, "e f " * 50, "s"), (1, "e f " * 50, "s")], "doc_id long, text string, source string")
    out = M.stage(spark, df, "").collect()
    assert {x.doc_id for x in out} == {None, 1} and 3 <= len(out) <= 6
