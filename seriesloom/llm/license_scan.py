"""License scan by conditional compression.

Candidate blocks are runs of words around a licence's vocabulary: as many words to either
side as the longest template has, line breaks folded, but not over an empty line. A
block is compressed alone and with every template as a raw zstandard dictionary; the share
of bytes that a template saves says how much of the block's wording it explains, and
ranks the templates. Every template whose words the block may hold is then compared word for
word with it: the words to insert, delete and replace between the template and the part
of the block it aligns with. A template wins if at most ``most_different`` of its words differ;
the fewest differences, then the larger saving, then the name decide. What is left of
the block before and after that part is searched again, so that notices that follow each
other are all found.

A row has the lines in which the notice stands, as code points, end exclusive, and the
savings on these lines. Null, empty and unlicensed texts give no rows. Repeated rows are
scanned each. Very long texts and lines are read whole. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .batches import slices

# Wording of common licence notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
# Names of licences in SPDX lines; their notices are "SPDX-License-Identifier: <name>".
SPDX = (
    "0BSD", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0",
    "EPL-2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only",
    "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
)
TEMPLATES |= {f"{name} (SPDX)": f"SPDX-License-Identifier: {name}" for name in SPDX}
CUE = re.compile(r"licen[sc]e|copyright|redistribut|permission is hereby|public domain|\bSPDX\b|\bCC[ -]BY|\bGPL", re.I)
EMPTY_LINE = re.compile(r"\n[^\S\n]*\n")
WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", re.I)
RANKED = 3  # names in a row's ranking
MOST_DIFFERENT = 0.1

SCHEMA = "doc_id long, start long, end long, license string, saving double, n_different long, differences string, ranking array<string>"


@lru_cache(maxsize=4)
def _prepared(templates: tuple[tuple[str, str], ...]):
    plain = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
    ready = []
    for name, text in templates:
        raw = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        ready.append((name, zstandard.ZstdCompressor(level=3, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False)))
    words = {name: WORD.findall(text.lower()) for name, text in templates}
    return plain, ready, words, {name: Counter(w) for name, w in words.items()}, max(map(len, words.values()), default=0)


def savings(block: str, templates: dict[str, str]) -> list[tuple[float, str]]:
    """Share of the block's compressed bytes that each template saves, largest first."""
    plain, ready, *_ = _prepared(tuple(templates.items()))
    data = block.lower().encode()
    alone = len(plain.compress(data))
    return sorted(((1 - len(c.compress(data)) / alone, name) for name, c in ready), key=lambda x: (-x[0], x[1]))


def differences(block: list[str], template: list[str]) -> tuple[int, list[str]]:
    """Words that differ between a template and the part of a block it aligns with."""
    return aligned(block, template)[:2]


def aligned(block: list[str], template: list[str]) -> tuple[int, list[str], int, int]:
    """``differences``, and the part of the block."""
    match = difflib.SequenceMatcher(None, template, block, autojunk=False)
    pairs = [m for m in match.get_matching_blocks() if m.size]
    if not pairs:
        return len(template), [f"-{w}" for w in template], 0, 0
    # words of the block before the first and behind the last match are not the template's
    first, last = pairs[0], pairs[-1]
    out = [f"-{w}" for w in template[: first.a]]
    count = len(out)
    for op, a, b, c, d in match.get_opcodes():
        if op == "equal" or b <= first.a or a >= last.a + last.size:
            continue
        out += [f"-{w}" for w in template[a:b]] + [f"+{w}" for w in block[c:d]]
        count += max(b - a, d - c)
    rest = template[last.a + last.size :]
    return count + len(rest), out + [f"-{w}" for w in rest], first.b, last.b + last.size


def blocks(text: str, reach: int) -> Iterator[list[tuple[str, int, int]]]:
    """Words, with their places, around a licence's vocabulary: ``reach`` to either side."""
    if not CUE.search(text):
        return
    words = [(m.group().lower(), *m.span()) for m in WORD.finditer(text)]
    starts, ends = [w[1] for w in words], [w[2] for w in words]
    breaks = [m.start() for m in EMPTY_LINE.finditer(text)]
    done: list[int] = []
    for cue in CUE.finditer(text):
        at = bisect_right(breaks, cue.start())
        low = bisect_left(starts, breaks[at - 1]) if at else 0
        high = bisect_left(starts, breaks[at]) if at < len(breaks) else len(words)
        a, b = max(low, bisect_right(ends, cue.start()) - reach), min(high, bisect_left(starts, cue.end()) + reach)
        if done and a <= done[1] and low <= done[0]:
            done[1] = max(done[1], b)
            continue
        if done:
            yield words[done[0] : done[1]]
        done = [a, b]
    if done:
        yield words[done[0] : done[1]]


def notices(text: str, block: list[tuple[str, int, int]], templates: dict[str, str], most_different: float = MOST_DIFFERENT) -> Iterator[tuple]:
    """Each notice of a block: place of its lines, license, saving, number of differences, differences, ranking."""
    _, _, wording, bags, _ = _prepared(tuple(templates.items()))
    parts = [(0, len(block))]
    while parts:
        low, high = parts.pop()
        words = [w for w, _, _ in block[low:high]]
        held = Counter(words)
        # a template that lacks more words than may differ cannot win
        likely = {n for n, bag in bags.items() if sum((bag - held).values()) <= most_different * bag.total()}
        if not likely:
            continue
        best = None
        for saving, name in savings(text[block[low][1] : block[high - 1][2]], templates):
            if name in likely:
                count, changed, a, b = aligned(words, wording[name])
                if count <= most_different * len(wording[name]) and (best is None or (count, -saving, name) < best[0]):
                    best = ((count, -saving, name), changed, low + a, low + b)
        if best is None:
            continue
        (count, _, name), changed, a, b = best
        start, end = text.rfind("\n", 0, block[a][1]) + 1, text.find("\n", block[b - 1][2])
        end = len(text) if end < 0 else end
        ranked = savings(text[start:end], templates)
        yield start, end, name, next(s for s, n in ranked if n == name), count, changed, [n for _, n in ranked[:RANKED]]
        parts += [(b, high), (low, a)]


def identify(block: str, templates: dict[str, str], most_different: float = MOST_DIFFERENT):
    """The first winning template of a text with its saving and differences, and the ranking; None without a winner."""
    words = [(m.group().lower(), *m.span()) for m in WORD.finditer(block)]
    won = next(notices(block, words, templates, most_different), None) if words else None
    return won and won[2:]


def licenses(text: str, templates: dict[str, str], most_different: float = MOST_DIFFERENT) -> list[tuple]:
    """All notices of a text, in order."""
    reach = _prepared(tuple(templates.items()))[-1]
    found = [n for block in blocks(text, reach) for n in notices(text, block, templates, most_different)]
    return sorted(found, key=lambda n: (n[0], n[1], n[2]))


def scan(documents: DataFrame, templates: dict[str, str] | None = None, most_different: float = MOST_DIFFERENT) -> DataFrame:
    """One row per notice: place of its lines, license, saving, differences and ranking."""
    wanted = dict(templates or TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for a, b, name, saving, count, changed, ranking in licenses(text or "", wanted, most_different):
                        rows.append((doc_id, a, b, name, saving, count, " ".join(changed), ranking))
                columns = list(zip(*rows)) or [()] * 8
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.string(), pa.list_(pa.string())]
                names = ["doc_id", "start", "end", "license", "saving", "n_different", "differences", "ranking"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)
