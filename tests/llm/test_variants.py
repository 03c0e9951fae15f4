import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tessella.llm import variants as V


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=V.RATIO):
    out, forms = {}, {}
    for w, n in counts.items():
        found = [v for v in counts if near(w, v)]
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= ratio * n:
            forms[w] = best
        out[w] = [n, len(found)]
    rows = set()
    for w, (n, k) in out.items():
        last = w
        while last in forms:
            last = forms[last]
        rows.add((w, forms.get(w), last, n, k, counts[forms[w]] if w in forms else None))
    return rows


def got(spark, counts):
    df = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n int, N_near string") if counts else spark.createDataFrame([], "word string, n int, N_near string")
    return {tuple(r) for r in V.grouped(df.select("word", "n")).select("word", "form", "root", "n", "n_near", "form_n").collect()}


def counts_of(r, length, alphabet, n):
    words = Counter()
    for _ in range(n):
        w = "".join(r.choice(alphabet) for _ in range(length))
        words[w] += r.choice([1, 2, 2, 30, 500])
        for _ in range(r.randrange(4)):
            k = r.randrange(len(w) + 1)
            w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice(alphabet) + w[k:], w[:k] + r.choice(alphabet) + w[k + 1 :]]) or w
            words[w] += r.choice([1, 2, 2, 30, 500])
    return dict(words)


@pytest.mark.parametrize("length, alphabet", [(3, "ab"), (8, "aé"), (47, "abÿ"), (49, "ab"), (150, "aàc")])
def test_groups_as_brute_force(spark, length, alphabet):
    counts = counts_of(random.Random(length), length, alphabet, 40)
    assert got(spark, counts) == brute(counts)


def test_chains_ties_and_empty(spark):
    counts = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "aaabbbb": 20000, "zzzzzzz": 5, "zzzzzzy": 50, "zzzzzzx": 50, "lonely": 3}
    found = got(spark, counts)
    assert found == brute(counts) and {r[2] for r in found if r[0].startswith("a")} == {"aaabbbb"} and ("zzzzzzz", "zzzzzzx", "zzzzzzx", 5, 2, 50) in found
    assert got(spark, {}) == set()


def test_one_apart():
    r = random.Random(8)
    words = ["".join(r.choice("ab") for _ in range(r.randrange(6))) for _ in range(60)]
    assert all(V.one_apart(a, b) == near(a, b) for a in words for b in words)


def test_a_very_long_word(spark):
    r = random.Random(4)
    w = "".join(r.choice("abc") for _ in range(200_000))
    counts = {w: 50, w[:777] + w[778:]: 3, w[:-1] + "z": 2, w + "c": 1, w[::-1]: 9, "a" * 200_000: 4, "a" * 200_001: 40}
    found = {(len(x[0]), len(x[1] or ""), x[3], x[4]) for x in got(spark, counts)}
    assert found == {(200_000, 0, 50, 3), (199_999, 200_000, 3, 1), (200_000, 200_000, 2, 1), (200_001, 200_000, 1, 1), (200_000, 0, 9, 0), (200_000, 200_001, 4, 1), (200_001, 0, 40, 1)}


def test_hashes_are_of_the_deletions():
    r = random.Random(6)
    for n in (1, 2, 5, 60):
        word = np.array([r.choice([97, 98, 0x10FFFF]) for _ in range(n)], np.int64)
        whole = lambda x: int(V.hashed_deletions(np.array(x, np.int64))[0]) if len(x) else 0
        keys = V.hashed_deletions(word).tolist()
        assert set(keys[1:]) == {whole([c for k, c in enumerate(word.tolist()) if k != i]) for i in range(n)} and keys[0] == whole(word.tolist())


def test_words_of_texts(spark, tmp_path):
    rows = [(31 * k, t, "x") for k, t in enumerate(["Straße Déjà-vu ABCDEFGH", "abcdefgh ×÷×÷×÷× ÀÉÎÕÜßÿ", None, "", "short", "abcdefgh" * 2000, "ÉCOLEÉCOLE abcdefgz9abcdefgh_Abcdefgh"] * 9)] + [(None, "nothing abcdefgh", "x")] * 3
    spark.createDataFrame(rows, "doc_id long, text string, word string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for i, text, _ in rows:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
                run = ""
    want = brute({w: n for w, n in counts.items() if len(w) >= 7 and n >= 2})
    assert {tuple(r) for r in V.op11_variants(spark, str(tmp_path)).select("word", "form", "root", "n", "n_near", "form_n").collect()} == want
