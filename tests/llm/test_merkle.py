import hashlib
import random
import zlib

import pytest

from tessella.llm import merkle as M

H = lambda s: hashlib.sha256(s.encode()).hexdigest()
KIND = "doc_id long, source string, lang string, n_chars long, text string, leaf string, Root long"


def leaf(fields):
    return H("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tree(nodes):
    """(root, proofs): of each node what stands beside it, as (side, digest)."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            if i ^ 1 < len(nodes):
                proofs[k].append((i & 1, nodes[i ^ 1]))
            else:
                proofs[k].append((0, ""))
        nodes = [H("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        at = [i >> 1 for i in at]
    return nodes[0], proofs


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs, inner = [], {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r[:5])))
        root, inner[g] = tree([leaf(r[:5]) for r in groups[g]])
        subs.append(root)
    root, outer = tree(subs)
    out = []
    for g, sub, upper in zip(order, subs, outer):
        for r, proof in zip(groups[g], inner[g]):
            i, source, lang, n, text = r[:5]
            node = leaf((i, source, lang, n + 1 if n is not None and i is not None and zlib.crc32(str(i).encode()) % 7 == 0 else n, text))
            for side, digest in proof + upper:
                node = H(digest + node if side else node + digest)
            out.append((i, leaf(r[:5]), sub, root, H("".join(d for _, d in proof + upper)), node, node == root))
    return sorted(out, key=str)


def cases():
    r = random.Random(9)
    row = lambda i, lang: (i, r.choice(["a", None, "é"]), lang, r.choice([None, 5, 70]), r.choice([None, "", "text", "ü" * 999, "1:a"]), "x", 1)
    yield "one", [row(3, "en")]
    yield "lone groups", [row(k, lang) for k, lang in enumerate(["b", "a", None, "", "é", "z", "B"])]
    for n in (2, 15, 16, 17, 255, 256, 257, 300):
        yield f"{n}", [row(k, "en") for k in range(n)] + [row(k, None) for k in range(n // 3)]
    yield "ties", [row(r.choice([None, 1, 2]), "en") for _ in range(90)] + [(1, "a", "en", 5, "t", "x", 1)] * 40
    yield "many groups", [row(k, f"l{k % 40}") for k in range(400)]


@pytest.mark.parametrize("name, rows", list(cases()))
def test_as_brute_force(spark, tmp_path, name, rows):
    random.Random(1).shuffle(rows)
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    df = M.op13_merkle(spark, str(tmp_path))
    assert sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str) == brute(rows)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], KIND).write.parquet(f"{tmp_path}/documents.parquet")
    assert M.op13_merkle(spark, str(tmp_path)).count() == 0
