"""Personal data: exact patterns, and a skip-chain conditional random field for what they miss.

The patterns (email, ip, card, phone) are found in linear time. The field's nodes are the words of a document that hold
a digit or an at sign (also spelled out, as in "a[at]b[dot]c"); neighbouring words and distant words of the same digits or
spelling share potentials. Words in a pattern's span are evidence, their label is known; loopy message passing carries it
to the other words. Neighbouring words that come out sure enough of one label are an added span.

Neighbouring words that together write a span in another way are one node: numbers whose joined digits end a phone number
or are a card's, four numbers that are an address, names around a spelled-out "at" and "dot" (the domain may stop after
its first name), a card's last four digits that are masked or announced. Its skips go to the span's words.

Weights come from maximum pseudo-likelihood over counts taken from a bounded sample of documents (SAMPLE_DOCS, smallest
hashes), labelled by the patterns. As a pattern finds its own repeats, each span of the sample is also repeated with the
pattern's marks hidden (no plus, other separators, signs spelled out), beside a decoy of the same shape that no span
shares digits or spelling with; so the field learns that the repetition decides, not the shape.

Null texts count as empty: no spans. Repeated rows give repeated results. Without any sample the field adds nothing. An
empty table gives an empty result. A column pii_spans is replaced, all others pass through.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import others, table, tuned

#: Kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
SAMPLE_DOCS = 4000
ROUNDS, SURE = 12, 0.5
#: Log potential of a label that evidence rules out.
IMPOSSIBLE = -1e4
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_HINT = re.compile(r"[0-9@]|[\[({](?:at|AT)[\])}]")
_AT = re.compile(r"[\[({](?:at|AT|@)[\])}]|(?<=[A-Za-z0-9])_(?:at|AT)_(?=[A-Za-z0-9])")
_DOT = re.compile(r"[\[({](?:dot|DOT|\.)[\])}]|(?<=[A-Za-z0-9])_(?:dot|DOT)_(?=[A-Za-z0-9])")
_AT_SIGN, _AT_WORD, _DOT_WORD = re.compile(r"(?i)@|(?<![a-z0-9])at(?![a-z0-9])"), re.compile(r"(?i)[\[({<]?(?:at|@)[\])}>]?"), re.compile(r"(?i)[\[({<]?(?:dot|\.)[\])}>]?")
_NUMBER, _JOINER = re.compile(r"[(\[]*\+?[0-9][0-9()+./-]*[)\],;:!?]*"), re.compile(r"[-/.]+")
_MASKED, _FOUR = re.compile(r"[*xX#][*xX#-]*([0-9]{4})[\]).,;:!?]*"), re.compile(r"[0-9]{4}[\]).,;:!?]*")
#: Words, among the two before it, that announce a number's last digits.
_ENDING = frozenset(("ending", "ends", "last", "digits"))
_EDGES = "[]<>{}\"'.,;:!?#$%&*|"
_ADDRESS = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")

Span = tuple[int, int, int]  # kind's number, start, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield 0, start, m.end()
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))


def _addresses(text: str) -> Iterator[Span]:
    for m in _DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        at, parts = m.start(), m[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p := x.lstrip("0") or "0") <= 3 and int(p) <= 255 for x in four):
                yield 1, at, at + size
            at += size + 1


def pattern_spans(text: str | None) -> list[Span]:
    """The spans of the four patterns, by kind, then start."""
    if not text or not _HINT.search(text):
        return []
    out = [*_emails(text), *_addresses(text)]
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def _plain(word: str) -> str:
    """A word without the marks around it, with signs that are spelled out put back."""
    return _DOT.sub(".", _AT.sub("@", word)).strip(_EDGES).lower()


def _keys(word: str) -> set[str]:
    """What a word shares with its repeats: its plain spelling; of a long number also all its digits, and the last seven."""
    plain = _plain(word)
    d = _digits(plain)
    if len(d) < 7 or any(c.isalpha() or c == "@" for c in plain) or _ADDRESS.fullmatch(plain):
        return {plain} if plain else {word}
    return {plain, d, d[-7:]}


def _shape(word: str) -> tuple[int, ...]:
    """Categories of a word that the field's node potentials depend on."""
    d = _digits(word)
    n = len(d)
    size = 0 if not n else 1 if n < 4 else 2 if n < 7 else 3 if n < 9 else 4 if n < 13 else 5 if n < 20 else 6
    core = word.strip("()[]<>{}\"'.,;:!?#$%&*|")
    parts = core.split(".")
    return (
        size,
        min(_AT.sub("@", word).count("@"), 2),
        min(word.count("."), 4),
        int(word.startswith("+")),
        int("-" in word) + 2 * int("(" in word or ")" in word),
        int(any(c.isalpha() for c in word)),
        int(13 <= n <= 19 and luhn(d)),
        int(len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 for p in parts)),
        int(_plain(word) != word.strip(_EDGES).lower()),
    )


#: Number of categories of each part of a shape.
SIZES = (7, 3, 5, 2, 4, 2, 2, 2, 2)


#: Most dots on each side of a spelled-out at sign, and most characters of a word that is part of a number.
DOTS, PART = 6, 40
Group = tuple[int, set, tuple[int, ...]]  # last word, keys, shape


def _told_keys(kind: int, span: str) -> set[tuple[str, str]]:
    """What a span shares with other ways to write it."""
    d = _digits(span)
    if kind == 0:
        local, domain = span.lower().split("@")
        return {("@", f"{local}@{domain}"), ("@", f"{local}@{domain.split('.')[0]}")}
    if kind == 1:
        return {("ip", ".".join(p.lstrip("0") or "0" for p in span.split(".")))}
    return {("n", d), ("four", d[-4:])} if kind == 2 else {("n", d[k:]) for k in range(len(d) - 6)}


class Respelled:
    """Runs of words outside the told spans that write one of these in another way. groups: by first word; anchors: keys by a told span's last word."""

    def __init__(self, text: str, told: list[Span]) -> None:
        self.groups: dict[int, Group] = {}
        self.anchors: dict[int, set] = {}
        if not told:
            return
        self.text, self.words = text, [m.span() for m in _WORD.finditer(text)]
        self.starts = [a for a, _ in self.words]
        self.taken: set[int] = set()
        for kind, a, b in told:
            first, last = bisect_right(self.starts, a) - 1, bisect_right(self.starts, b - 1) - 1
            self.taken.update(range(first, last + 1))
            self.anchors.setdefault(last, set()).update(_told_keys(kind, text[a:b]))
        self.known = set().union(*self.anchors.values())
        sorts = {x[0] for x in self.known}
        if "@" in sorts:
            self._mails()
        if sorts - {"@"}:
            self._numbers()

    def _word(self, k: int) -> str:
        a, b = self.words[k]
        return self.text[a:b]

    def _put(self, first: int, last: int, keys: set, as_one: str, spelled: bool) -> None:
        shape = _shape(as_one)
        self.groups[first] = last, keys, (*shape[:-1], 1) if spelled else shape
        self.taken.update(range(first, last + 1))

    def _side(self, k: int, step: int, own: str) -> list[tuple[int, str]]:
        """(word, spelling) on one side of an at sign, shorter ones first: the rest of the sign's own word or the next one, and what dots add."""
        free = lambda x: 0 <= x < len(self.words) and x not in self.taken
        if not own:
            k += step
            if not free(k) or self.words[k][1] - self.words[k][0] > 255:
                return []
            own = _plain(self._word(k)).strip("()")
        out = [(k, own)]
        while len(out) <= DOTS and free(k + step) and free(k + 2 * step) and _DOT_WORD.fullmatch(self._word(k + step)):
            k += 2 * step
            more = _plain(self._word(k)).strip("()")
            out.append((k, f"{out[-1][1]}.{more}" if step > 0 else f"{more}.{out[-1][1]}"))
        return out

    def _mails(self) -> None:
        for m in _AT_SIGN.finditer(self.text):
            k = bisect_right(self.starts, m.start()) - 1
            if k in self.taken or self.words[k][1] - self.words[k][0] > 255:
                continue
            w = self._word(k)
            left, sign, right = ("", "@", "") if _AT_WORD.fullmatch(w) else _plain(w).strip("()").partition("@")
            if not sign or "@" in right:
                continue
            found = ((a, b, key) for a, x in reversed(self._side(k, -1, left)) for b, y in reversed(self._side(k, 1, right)) if (key := ("@", f"{x}@{y}")) in self.known)
            if hit := next(found, None):
                self._put(hit[0], hit[1], {hit[2]}, hit[2][1], True)

    def _numbers(self) -> None:
        """From left to right, the longest run of numbers that a key fits."""
        n, first = len(self.words), 0
        while first < n:
            digits, parts, best, k = "", [], None, first
            while k < n and k not in self.taken and len(digits) < 20 and self.words[k][1] - self.words[k][0] <= PART:
                w = self._word(k)
                if _NUMBER.fullmatch(w):
                    digits += _digits(w)
                    parts += [p.lstrip("0") or "0" for p in re.findall("[0-9]+", w)]
                    if len(parts) == 4 and (key := ("ip", ".".join(parts))) in self.known:
                        best = k, {key}, key[1], True
                    elif hits := {x for x in (("n", digits), ("n", digits.lstrip("0"))) if x in self.known}:
                        best = k, hits, w if k == first else digits, False
                elif k == first or not _JOINER.fullmatch(w):
                    break
                k += 1
            if best:
                self._put(first, *best)
                first = best[0]
            elif first not in self.taken and self.words[first][1] - self.words[first][0] <= PART:
                w = self._word(first)
                told = _MASKED.fullmatch(w) or _FOUR.fullmatch(w) and any(self._word(x).strip(_EDGES).lower() in _ENDING for x in range(max(first - 2, 0), first))
                if told and (key := ("four", _digits(w))) in self.known:
                    self._put(first, first, {key}, f"xxxx-{key[1]}", True)
            first += 1


class Field:
    """Nodes and edges of one document. words: (start, end); label: by the patterns; chain, skip: pairs of nodes; respelled: nodes that write a told span in another way.

    Told spans (by default all of them) are those whose other spellings are looked for.
    """

    def __init__(self, text: str, spans: list[Span], told: list[Span] | None = None) -> None:
        self.words: list[tuple[int, int]] = []
        self.shapes: list[tuple[int, ...]] = []
        self.labels: list[int] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []
        self.respelled: set[int] = set()
        before, last = -2, {}
        ordered, near = sorted((a, b, k) for k, a, b in spans), 0
        other = Respelled(text, spans if told is None else told)
        for pos, m in enumerate(_WORD.finditer(text)):
            w = m[0]
            group = other.groups.get(pos)
            if pos <= before or not (group or _HINT.search(w)):
                continue
            k = len(self.words)
            start, end = m.start(), other.words[group[0]][1] if group else m.end()
            self.words.append((start, end))
            self.shapes.append(group[2] if group else _shape(w))
            while near < len(ordered) and ordered[near][1] <= start:
                near += 1
            self.labels.append(next((1 + x[2] for x in ordered[near : near + 8] if x[0] < end and x[1] > start), 0))
            beside = before == pos - 1
            if beside:
                self.chain.append((k - 1, k))
            before = group[0] if group else pos
            keys = set() if group and group[0] > pos else _keys(w)
            if group:
                self.respelled.add(k)
                keys |= group[1]
            keys |= other.anchors.get(before, set())
            self.skip += [(j, k) for j in sorted({last[x] for x in keys if x in last}) if not (beside and j == k - 1)]
            last |= dict.fromkeys(keys, k)

    def around(self, start: int = 0) -> Iterator[tuple]:
        """(shape, label, neighbours' labels in the chain, and by skips) of each node; at most two neighbours of each sort are counted.

        Before position `start`, nodes with a label are left out, and their repeats, as nobody has told what these are.
        """
        near, far = [[] for _ in self.words], [[] for _ in self.words]
        for edges, out in ((self.chain, near), (self.skip, far)):
            for a, b in edges:
                out[a].append(self.labels[b])
                out[b].append(self.labels[a])
        for s, y, p, q, (a, _) in zip(self.shapes, self.labels, near, far, self.words, strict=True):
            if a < start and (y or any(q)):
                continue
            yield (*s, y, *sorted(p)[:2], *[-1] * (2 - len(p[:2])), *sorted(q)[:2], *[-1] * (2 - len(q[:2])))


class Crf:
    """Node weights by shape, and symmetric edge weights of the chain and of the skips; those of the skips tell only same from other labels."""

    def __init__(self, node: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> None:
        self.node, self.chain, self.skip = node, chain, skip
        self.starts = np.concatenate([[0], np.cumsum(SIZES)[:-1]])

    @staticmethod
    def fit(counts: Counter, steps: int = 1000, decay: float = 1e-4) -> Crf | None:
        """Maximum pseudo-likelihood, by gradient steps over the distinct neighbourhoods with their counts."""
        if not counts:
            return None
        rows, own = np.array(sorted(counts), int), len(SIZES)
        weight = np.array([counts[tuple(r)] for r in rows.tolist()], float)
        # Repeats of words in spans are rare, but what the field is for: of each shape they weigh as much as all else, and all shapes alike.
        shape = np.unique(rows[:, :own], axis=0, return_inverse=True)[1].ravel()
        group = 3 * shape + np.where((rows[:, own + 3 :] > 0).any(1), 2, (rows[:, own + 3 :] == 0).any(1))
        weight /= np.bincount(group, weight)[group]
        weight /= weight.sum()
        starts, n, m = np.concatenate([[0], np.cumsum(SIZES)[:-1]]), len(rows), len(LABELS)
        x = np.zeros((n, sum(SIZES) + 2 * m))
        for k in range(len(SIZES)):
            x[np.arange(n), starts[k] + rows[:, k]] = 1
        for base, cols in ((sum(SIZES), (own + 1, own + 2)), (sum(SIZES) + m, (own + 3, own + 4))):
            for c in cols:
                ok = rows[:, c] >= 0
                np.add.at(x, (np.flatnonzero(ok), base + rows[ok, c]), 1)
        y = np.eye(m)[rows[:, own]]
        w, speed = np.zeros((x.shape[1], m)), np.zeros((x.shape[1], m))
        for _ in range(steps):
            z = x @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            speed = 0.9 * speed + x.T @ ((y - p) * weight[:, None]) - decay * w
            w += 0.5 * speed
            for base in (sum(SIZES), sum(SIZES) + m):  # an edge's potential is the same from either end
                w[base : base + m] = (w[base : base + m] + w[base : base + m].T) / 2
            same = np.eye(m, dtype=bool)  # repeats agree, whatever their label is: else two words without evidence would talk each other into one
            w[-m:] = np.where(same, w[-m:][same].mean(), w[-m:][~same].mean())
        k = sum(SIZES)
        return Crf(w[:k], w[k : k + m], w[k + m :])

    def marginals(self, f: Field) -> np.ndarray:
        """Label probabilities of each node, by loopy message passing (in logs, all messages at once); labels of spans are given."""
        m = len(LABELS)
        node = self.node[self.starts + np.array(f.shapes)].sum(1)
        known = np.flatnonzero(f.labels)
        node[known] = IMPOSSIBLE
        node[known, np.array(f.labels)[known]] = 0
        edges = np.array(f.chain + f.skip, int).reshape(-1, 2)
        if half := len(edges):
            src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
            n = len(f.chain)
            kinds = [(slice(0, n), self.chain), (slice(n, half), self.skip), (slice(half, half + n), self.chain.T), (slice(half + n, None), self.skip.T)]
            shared = [(rows, np.exp(pot - pot.max())) for rows, pot in kinds]
            msg = np.zeros((2 * half, m))
            gather = lambda: node + np.stack([np.bincount(dst, msg[:, k], len(node)) for k in range(m)], 1)
            for _ in range(ROUNDS):
                out = gather()[src] - np.concatenate([msg[half:], msg[:half]])
                out = np.exp(out - out.max(1, keepdims=True))
                for rows, pot in shared:  # one matrix for all edges of a kind
                    out[rows] = out[rows] @ pot
                new = np.log(np.maximum(out, 1e-300))
                msg = 0.5 * msg + 0.5 * (new - new.max(1, keepdims=True))
            node = gather()
        p = np.exp(node - node.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def find(text: str | None, crf: Crf | None) -> tuple[list[Span], list[Span]]:
    """Pattern spans, and the spans that the field adds: neighbouring words outside all pattern spans, sure of one label."""
    base = pattern_spans(text)
    if not text or crf is None or not _HINT.search(text):
        return base, []
    f = Field(text, base)
    telling = [not y and (s[0] >= 3 or s[1] > 0 or k in f.respelled) for k, (s, y) in enumerate(zip(f.shapes, f.labels, strict=True))]
    if not any(telling):
        return base, []  # no word that could be a span
    p = crf.marginals(f)
    best = p.argmax(1)
    sure = [k for k, y in enumerate(f.labels) if not y and best[k] and p[k, best[k]] >= SURE]
    beside, runs = set(f.chain), []
    for k in sure:
        if runs and (k - 1, k) in beside and runs[-1][-1] == k - 1 and best[k] == best[k - 1]:
            runs[-1].append(k)
        else:
            runs.append([k])
    added = []
    for run in runs:
        if any(telling[k] for k in run):
            a, b = f.words[run[0]][0], f.words[run[-1]][1]
            w = text[a:b]
            left, right = _EDGES + "(" * (")" not in w), _EDGES + ")" * ("(" not in w)
            added.append((int(best[run[0]]) - 1, a + len(w) - len(w.lstrip(left)), b - len(w) + len(w.rstrip(right))))
    return base, added


def _hidden(kind: int, span: str) -> list[str]:
    """A span as a text may repeat it without the marks that the patterns look for."""
    if kind == 0:
        return [span.replace("@", "[at]").replace(".", "[dot]"), span.replace("@", "[at]"), span.replace("@", " at ").replace(".", " dot ")]
    if kind == 1:
        return [span.replace(".", "[.]"), span.replace(".", "-")]
    d = _digits(span)
    if kind == 2:
        fours = [d[k : k + 4] for k in range(0, len(d), 4)]
        return [".".join(fours), "  ".join(fours), f"xxxx-{d[-4:]}"]
    return [span.lstrip("+"), d, d[-7:-4] + "-" + d[-4:], d[-10:-7] + "." + d[-7:-4] + "." + d[-4:], d[-10:-7] + " " + d[-7:-4] + " " + d[-4:]]


#: Turns a span into another of the same shape; signs that are spelled out stay.
_DECOY = re.compile(r"\[(?:at|dot)\]|(?<=\x20)(?:at|dot)(?=\x20)|[A-Za-z0-9]+")
_OTHER = {ord(x[k]): x[(k + 3) % len(x)] for x in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") for k in range(len(x))}


def decoy(repeat: str, times: int = 1) -> str:
    for _ in range(times):
        repeat = _DECOY.sub(lambda m: m[0] if m[0][0] == "[" or m[0] in ("at", "dot") else m[0].translate(_OTHER), repeat)
    return repeat


def lessons(text: str) -> Iterator[tuple]:
    """What around() gives for the words of a text whose labels aren't given when the field is used.

    Each span is repeated with its marks hidden, one form at a time, beside decoys without a label: one alone, one twice.
    """
    base = pattern_spans(text)
    forms = [[x for x in _hidden(kind, text[a:b]) if not pattern_spans(x)] for kind, a, b in base]
    for k in range(max(map(len, forms), default=0) or 1):
        spans, parts, at = list(base), [text], len(text)
        for (kind, _, _), each in zip(base, forms, strict=True):
            if k < len(each):
                alone, twice = decoy(each[k]), decoy(each[k], 2)
                line = f"\nand {each[k]} or {alone} or {twice} or {twice}\n"
                spans.append((kind, at + 5, at + 5 + len(each[k])))
                parts.append(line)
                at += len(line)
        yield from Field("".join(parts), spans, base).around(len(text))


def sample_counts(docs: DataFrame, most: int = SAMPLE_DOCS, text: str = "text") -> Counter:
    """Neighbourhood counts (a bounded number of categories) over at most `most` documents, those of smallest hash."""
    chosen = docs.where("doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    names = [f"c{k}" for k in range(len(SIZES) + 5)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for b in batches:
            for x in b.column(0):
                t = x.as_py()
                if t and _HINT.search(t):
                    c.update(lessons(t))
        if c:
            rows = np.array(list(c), int)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, k], pa.int32()) for k in range(rows.shape[1])] + [pa.array(list(c.values()), pa.int64())], names=[*names, "n"])

    counts = docs.join(F.broadcast(chosen), "doc_id").select(text).mapInArrow(run, ", ".join(f"{n} int" for n in names) + ", n long")  # `most` ids at most
    return Counter({tuple(r[:-1]): r[-1] for r in counts.groupBy(*names).agg(F.sum("n").alias("n")).collect()})


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))


def detect(docs: DataFrame, crf: Crf | None, text: str = "text") -> DataFrame:
    """docs with a column pii_spans: by kind, then start; base tells pattern spans from added ones."""
    schema = T.StructType(others(docs.schema.fields, "pii_spans") + [T.StructField("pii_spans", SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(SPANS)
        for b in batches:
            out = []
            for x in b.column(text):
                base, added = find(x.as_py(), crf)
                out.append([{"kind": KINDS[k], "start": a, "end": e, "base": own} for k, a, e, own in sorted([(*s, True) for s in base] + [(*s, False) for s in added])])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], names=[*b.schema.names, "pii_spans"])

    return docs.drop("pii_spans").mapInArrow(run, schema)


def redact(docs: DataFrame, crf: Crf | None, text: str = "text") -> DataFrame:
    """docs with every span in the text replaced by its kind in angle brackets; spans that overlap become one."""
    kinds = docs.schema

    def clean(t: str) -> str:
        base, added = find(t, crf)
        out, at, last = [], 0, -1
        for a, b, k in sorted((a, b, k) for k, a, b in base + added):
            if a >= last:
                out += [t[at:a], f"<{KINDS[k].upper()}>"]
            last = at = max(last, b)
        return "".join([*out, t[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([None if (t := x.as_py()) is None else clean(t) for x in b.column(text)], pa.string())
            yield pa.RecordBatch.from_arrays([new if n == text else b.column(n) for n in b.schema.names], names=b.schema.names)

    return docs.mapInArrow(run, kinds)


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tuned(spark), sf_dir, "documents").select("doc_id", "text")
    found = detect(docs, Crf.fit(sample_counts(docs))).drop("text")
    spans, base = F.col("pii_spans"), F.filter("pii_spans", lambda s: s["base"])
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter(base, _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(spans).alias("spans"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data is cut out of the texts; n_chars follows the new text."""
    tuned(spark)
    out = redact(docs, Crf.fit(sample_counts(docs.select("doc_id", "text"))))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


