"""BPE encoding and decoding.

Encoding backtracks: an Aho-Corasick automaton over the vocabulary gives the longest token at a position; a table of
merges tells whether two neighbouring tokens could both come out of the merges (else a shorter token is tried, or the
last one is taken back). Every position is left at most once per token length, so the time is linear in the text.
Decoding copies byte ranges by an offset table.

Null texts count as empty and give no ids. Repeated rows give repeated results. Extra columns pass through.
"""

from __future__ import annotations

import functools
import hashlib
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import others, table, tuned

#: Fixed value: the pattern by which byte-level BPE splits text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces, and pairs of tokens, that a worker remembers, twice as many at most; forgetting changes no result.
MEMO = 80_000
#: Ids decoded at a time, so that a very long text needs little memory besides its own.
DECODE_IDS = 1 << 20


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself if printable in Latin-1, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def gather(flat: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> bytes:
    """The entries of an offset table, one after another."""
    out = []
    for k in range(0, len(ids), DECODE_IDS):
        part = ids[k : k + DECODE_IDS]
        start, size = offsets[part], offsets[part + 1] - offsets[part]
        ends = np.cumsum(size)
        out.append(flat[np.repeat(start - (ends - size), size) + np.arange(ends[-1])].tobytes())
    return b"".join(out)


def _offset_table(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(entries), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in entries])]).astype(np.int64)


class BpeCodec:
    """Encoder and decoder for one byte-level vocabulary file of the tokenizers format."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = _byte_of_char()
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        # Tokens are numbered by age here: the 256 bytes, then the merges in order.
        names = [c for c in byte_of] + ["".join(m) for m in merges]
        age = {name: k for k, name in enumerate(names)}
        self.left, self.right, self.merged = [-1] * 256, [-1] * 256, {}
        for k, (a, b) in enumerate(merges):
            self.left.append(age[a])
            self.right.append(age[b])
            self.merged.setdefault((age[a], age[b]), 256 + k)
        raw = [bytes(byte_of[c] for c in name) for name in names]
        self.size = [len(x) for x in raw]
        sound = [True] * 256
        for t in range(256, len(names)):
            a, b = self.left[t], self.right[t]
            sound.append(sound[a] and sound[b] and self.fits(a, b, t))
        self.automaton = ahocorasick.Automaton()
        kept = {}
        for t, x in enumerate(raw):
            if sound[t]:
                kept[x] = t
                self.automaton.add_word(x.decode("latin-1"), t)
        self.automaton.make_automaton()
        self.shorter = [-1] * len(names)  # the longest token that a token begins with
        for x, t in kept.items():
            self.shorter[t] = next((kept[x[:n]] for n in range(len(x) - 1, 0, -1) if x[:n] in kept), -1)
        self.public = np.array([vocab[name] for name in names], np.uint32)
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        entries = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for name, x in zip(names, raw, strict=True):
            entries[vocab[name]] = x
        for name, k in self.special.items():
            entries[k] = name.encode()
        self.bytes_of = _offset_table(entries)
        self.digits_of = _offset_table([b"%d," % k for k in range(len(entries))])
        self.pieces = regex.compile(SPLIT).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.kept = {x.decode("latin-1"): t for x, t in kept.items()}
        self.ids = self.public.tolist()
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def fits(self, a: int, b: int, below: int = 1 << 60) -> bool:
        """Whether merging would leave tokens a and b side by side, looking only at merges older than below.

        Walks back through the merges that made the two: whatever stood at their border at any time must not have been
        merged before the parts grew on.
        """
        while True:
            m = self.merged.get((a, b))
            if m is not None and m < below:
                return False
            if a > b:
                if a < 256:
                    return True
                below, a = a, self.right[a]
            else:
                if b < 256:
                    return True
                below, b = b + 1, self.left[b]

    def merge_piece(self, piece: bytes) -> list[int]:
        """Ages of the tokens of one piece, by backtracking."""
        text, end = piece.decode("latin-1"), len(piece)
        if text in self.kept:
            return [self.kept[text]]
        longest, size, shorter, pairs = self.automaton.iter_long, self.size, self.shorter, self.pairs
        if len(pairs) > MEMO:
            pairs.clear()
        dead = bytearray(end + 1)
        out: list[int] = []
        pos, token = 0, next(longest(text))[1] if end else -1
        while token >= 0:
            last = out[-1] if out else -1
            while token >= 0:
                stop = pos + size[token]
                if not dead[stop]:
                    ok = last < 0 or pairs.get((last, token))
                    if ok is None:
                        ok = pairs[last, token] = self.fits(last, token)
                    if ok:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                pos = stop
                token = next(longest(text, pos))[1] if pos < end else -1
            else:
                dead[pos] = 1
                token = out.pop()
                pos -= size[token]
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text (uint32); strings of special tokens become their ids, as the tokenizers library has it by default."""
        if not text:
            return np.empty(0, np.uint32)
        out = []
        for k, part in enumerate(self.specials.split(text) if self.specials else [text]):
            if k % 2:
                out.append(np.uint32(self.special[part]).tobytes())
                continue
            words = self.pieces(part)
            missing = set(words).difference(self.memo)
            if len(self.memo) + len(missing) > MEMO:
                self.memo, self.old, missing = {}, self.memo, set(words)
            memo, old, ids = self.memo, self.old, self.ids
            for w in missing:
                memo[w] = old.get(w) or array("I", [ids[t] for t in self.merge_piece(w.encode())]).tobytes()
            out.append(b"".join([memo[w] for w in words]))
        return np.frombuffer(b"".join(out), np.uint32)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return gather(*self.bytes_of, np.asarray(ids, np.int64))

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def joined(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        return gather(*self.digits_of, np.asarray(ids, np.int64))[:-1]


@functools.lru_cache(4)
def codec(path: str) -> BpeCodec:
    return BpeCodec(path)


def _with(batch: pa.RecordBatch, drop: str | None, **columns: pa.Array) -> pa.RecordBatch:
    keep = [(n, batch.column(k)) for k, n in enumerate(batch.schema.names) if n != drop]
    names = [n for n, _ in keep] + list(columns)
    return pa.RecordBatch.from_arrays([c for _, c in keep] + list(columns.values()), names=names)


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of token ids in place of the text."""
    schema = T.StructType(others(docs.schema.fields, text, ids) + [T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            each = [c.encode(x.as_py()) for x in b.column(text)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int32)
            flat = np.concatenate(each).astype(np.int32) if each else np.empty(0, np.int32)
            yield _with(b, text, **{ids: pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))})

    return docs.drop(ids).mapInArrow(run, schema)


def decode_documents(tokens: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """tokens with the decoded text in place of the ids."""
    schema = T.StructType(others(tokens.schema.fields, text, ids) + [T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            yield _with(b, ids, **{text: pa.array([c.decode(x.values.to_numpy(zero_copy_only=False) if x.is_valid else []) for x in b.column(ids)], pa.string())})

    return tokens.drop(text).mapInArrow(run, schema)


def digest(tokens: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """n_tokens, and SHA-256 of the joined ids and of the text that they decode to."""
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    tokens = tokens.drop(*(f.name for f in new))
    schema = T.StructType(others(tokens.schema.fields, ids) + new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            n, joined, decoded = [], [], []
            for x in b.column(ids):
                each = x.values.to_numpy(zero_copy_only=False)
                n.append(len(each))
                joined.append(hashlib.sha256(c.joined(each) if len(each) else b"").hexdigest())
                decoded.append(hashlib.sha256(c.decode(each).encode()).hexdigest())
            yield _with(b, ids, n_tokens=pa.array(n, pa.int64()), ids_sha256=pa.array(joined, pa.string()), decoded_sha256=pa.array(decoded, pa.string()))

    return tokens.mapInArrow(run, schema)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tuned(spark), sf_dir, "documents").select("doc_id", "text")
    path = vocabulary_path()
    return digest(encode_documents(docs, path), path)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the ids of every remaining text."""
    tuned(spark)
    tokens = encode_documents(docs.select("doc_id", "lang", "source", "text"), vocabulary_path())
    return tokens.withColumn("n_tokens", F.size("ids").cast("long"))
