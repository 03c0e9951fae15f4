import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessella.llm import bpe

PATH = bpe.vocabulary_path()
PIECES = ["the", " of", "  ", "\n", "\t\n x", "naïve", "日本語", "🎉🎉", "don't", "'ll", "12345", "$$$", "<|endoftext|>", "<|endof", "\x1c", "\x85", " ", "　", "é", "é", "aaaaaaaa", "​", "Ⅷ", "\r\n", "=====", "\x00"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    r = random.Random(3)
    yield from ["", " ", "a" * 5000, "ab" * 3000, " " * 3000, "\n" * 99, "x <|endoftext|> y<|endoftext|>"]
    for _ in range(1500):
        yield "".join(r.choice(PIECES) if r.random() < 0.5 else "".join(r.choices("abcdefghijklmnoprstuvwyzABC éèß.,!?-_/", k=r.randint(1, 12))) for _ in range(r.randint(1, 25)))


def test_as_the_library(library):
    c = bpe.codec(PATH)
    for t in texts():
        want = library.encode(t, add_special_tokens=False).ids
        got = c.encode(t)
        assert got.tolist() == want, repr(t)
        assert c.decode(got) == library.decode(want, skip_special_tokens=False)
        assert c.joined(got).decode() == ",".join(map(str, want)) if want else len(got) == 0


def test_broken_utf8_decodes_as_the_library(library):
    c, r = bpe.codec(PATH), np.random.default_rng(1)
    for _ in range(200):
        ids = r.integers(0, 50257, 8)
        assert c.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_full_memo_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    c = bpe.BpeCodec(PATH)
    t = "one two three four five six one two three four five"
    assert c.encode(t).tolist() == library.encode(t).ids


def test_round_trip_in_spark(spark):
    rows = [(1, "a b", "x"), (2, None, "y"), (3, "", None), (3, "", None), (None, "é" * 3000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    enc = bpe.encode_documents(df, PATH)
    assert sorted(map(str, (r.text for r in bpe.decode_documents(enc, PATH).collect()))) == sorted(["a b", "", "", "", "é" * 3000])
    assert bpe.digest(enc, PATH).count() == 5
    assert bpe.digest(bpe.encode_documents(df.limit(0), PATH), PATH).count() == 0
