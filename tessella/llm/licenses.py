"""License scans by conditional compression.

Candidate blocks are the words around license vocabulary. A block is compressed alone and with each template as a
zstandard raw dictionary; the bytes saved rank the templates. They are confirmed in that order, by their exact wording
differences: the template's words are aligned with the block's, a match must hold nearly all of them, in one stretch, and
must not differ in a word that carries meaning (numbers, "not", "non...", a license's name). The first that is confirmed
wins; what lies before and after it is looked at again. No template is left out for saving little: short ones save few
bytes in a long block.

Null texts count as empty: no spans. Repeated rows give repeated results. Texts of any length are scanned whole. An empty
table gives an empty result. A column licenses is replaced, all others pass through.
"""

from __future__ import annotations

import difflib
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import others, table, tuned

#: Wordings of public licenses and their notices, by SPDX-like name.
TEMPLATES = {
    "MIT/notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0+": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0+": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1+": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "CC-BY-NC-4.0/notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0/notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "BSD-3-Clause/endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "AGPL-3.0+": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "SPDX/MIT": "SPDX-License-Identifier: MIT",
    "SPDX/Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "SPDX/BSD-2-Clause": "SPDX-License-Identifier: BSD-2-Clause",
    "SPDX/BSD-3-Clause": "SPDX-License-Identifier: BSD-3-Clause",
    "SPDX/GPL-2.0-only": "SPDX-License-Identifier: GPL-2.0-only",
    "SPDX/GPL-3.0-or-later": "SPDX-License-Identifier: GPL-3.0-or-later",
    "SPDX/MPL-2.0": "SPDX-License-Identifier: MPL-2.0",
}
_HINT = re.compile(r"licen[sc]|permission|redistribut|copyright|unencumbered|\bSPDX\b|mozilla public", re.IGNORECASE)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = ".,;:!?\"'()[]<>*#$%&/"
#: A match holds so much of its template's words, and so much of its own stretch is the template's.
COVER = 0.9
#: Words that a worker remembers; forgetting changes no result.
MEMO = 65_536
#: Words of a block that are looked at together, in template lengths; longer blocks are looked at in overlapping parts.
PART = 4


@functools.lru_cache(MEMO)
def _plain(word: str) -> str:
    return word.strip(_EDGES).lower()


@functools.cache
def _templates() -> list[tuple[str, list[str], object]]:
    """Name, words and compressor of each template."""
    import zstandard

    out = []
    for name, text in TEMPLATES.items():
        words = [p for w in text.split() if (p := _plain(w))]
        raw = " ".join(words).encode()
        out.append((name, words, zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT))))
    return out


@functools.cache
def _alone():
    import zstandard

    return zstandard.ZstdCompressor(level=3)


def _weighty(word: str) -> bool:
    return any(c.isdigit() for c in word) or word in ("not", "no", "without") or word.startswith("non") or word in _names()


@functools.cache
def _names() -> frozenset[str]:
    return frozenset("mit isc bsd apache gnu gpl lgpl lesser affero mozilla mpl cc by by-nc by-nd by-sa by-nc-nd by-nc-sa by-nc-4.0 creative public domain".split()) - {"public"}


def blocks(text: str) -> Iterator[list[tuple[str, int, int]]]:
    """Stretches of (plain word, start, end) around license vocabulary, in parts that overlap by the longest template."""
    if not _HINT.search(text):
        return
    words = [(p, m.start(), m.end()) for m in _WORD.finditer(text) if (p := _plain(m[0]))]
    hit = np.array([bool(_HINT.search(w)) for w, _, _ in words], bool)
    if not hit.any():
        return
    reach = max(len(t[1]) for t in _templates())
    at = np.flatnonzero(hit)
    cuts = np.flatnonzero(np.diff(at) > 2 * reach) + 1
    for group in np.split(at, cuts):
        low, high = max(0, int(group[0]) - reach), min(len(words), int(group[-1]) + reach + 1)
        for k in range(low, max(low + 1, high - reach), (PART - 1) * reach):
            yield words[k : min(high, k + PART * reach)]


def gains(words: list[str]) -> list[tuple[float, int]]:
    """Relative size reductions of a block by each template, largest first."""
    raw = " ".join(words).encode()
    alone = len(_alone().compress(raw))
    return sorted(((1 - len(t[2].compress(raw)) / alone, k) for k, t in enumerate(_templates())), key=lambda x: (-x[0], x[1]))


def confirm(template: list[str], words: list[str]) -> tuple[int, int, list[str], list[str]] | None:
    """First and past-last word of the stretch that holds the template, the template's words that lack, and the words that are too many."""
    anchors = set(template)
    near = [k for k, w in enumerate(words) if w in anchors]
    if len({words[k] for k in near}) < COVER * len(anchors) - 1:
        return None
    match = difflib.SequenceMatcher(None, template, words, autojunk=False)
    parts = [m for m in match.get_matching_blocks() if m.size]
    while parts:  # leave out stray words far from the rest
        first, last = parts[0], parts[-1]
        start, stop = first.b, last.b + last.size
        held = sum(m.size for m in parts)
        if held >= COVER * (stop - start):
            break
        parts.remove(first if first.size <= last.size else last)
    if not parts or held < COVER * len(template):
        return None
    kept = {k for m in parts for k in range(m.a, m.a + m.size)}
    own = {k for m in parts for k in range(m.b, m.b + m.size)}
    lack = [w for k, w in enumerate(template) if k not in kept]
    extra = [words[k] for k in range(start, stop) if k not in own]
    if any(_weighty(w) for w in lack + extra):
        return None
    return start, stop, lack, extra


def find(text: str | None) -> list[dict]:
    """Licenses in a text, by start: license, start, end (code points), gain, lacking and extra words."""
    found: dict[tuple[str, int], dict] = {}
    for block in blocks(text or ""):
        rest = [block]
        while rest:  # what lies before and after a find may hold another
            part = rest.pop()
            words = [w for w, _, _ in part]
            if not any(_HINT.search(w) for w in words):
                continue
            for gain, k in gains(words):
                name, template, _ = _templates()[k]
                if got := confirm(template, words):
                    a, b, lack, extra = got
                    found[name, part[a][1]] = {"license": name, "start": part[a][1], "end": part[b - 1][2], "gain": round(gain, 6), "lacking": lack, "extra": extra}
                    rest += [x for x in (part[:a], part[b:]) if x]
                    break
    # Parts of a long block overlap: a notice that two of them met in different extents counts once, where most of it is.
    sizes = {name: len(template) for name, template, _ in _templates()}
    kept: list[dict] = []
    for x in sorted(found.values(), key=lambda x: (len(x["lacking"]) - sizes[x["license"]], len(x["extra"]), x["start"], x["license"])):
        if all(x["end"] <= k["start"] or k["end"] <= x["start"] for k in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: (x["start"], x["license"]))


FOUND = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("gain", T.DoubleType()), T.StructField("lacking", T.ArrayType(T.StringType())), T.StructField("extra", T.ArrayType(T.StringType()))]))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column licenses."""
    schema = T.StructType(others(docs.schema.fields, "licenses") + [T.StructField("licenses", FOUND)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(FOUND)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([find(x.as_py()) for x in b.column(text)], kind)], names=[*b.schema.names, "licenses"])

    return docs.drop("licenses").mapInArrow(run, schema)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tuned(spark), sf_dir, "documents").select("doc_id", "text")
    spans = F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string")))
    return scan(docs).select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(spans, ",").alias("spans"))
