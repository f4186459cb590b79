"""License scan by conditional compression.

Blocks of text that mention a license are compressed twice by zstandard: alone, and with a template's
words as raw dictionary. The bytes that a template saves, against what it saves on itself, rank the
templates for a block. Templates that save enough are confirmed by exact wording: the words that must be
inserted, dropped or changed to turn some stretch of the block into the template.

Words are lower-cased and bare of punctuation at their ends. Defined cases: null, empty and wordless texts
have no license; null ids are returned as they are; a license that a document states twice is one row, with
its best match; repeated documents give rows of their own; an empty table gives no rows; further columns are
ignored. Blocks reach further around a cue than the longest template and overlap by more than it, so none is cut
in two. A candidate block is one with a cue; every template has more cues than words that may differ, so a text
without any cannot state it closely enough.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping
from heapq import heapify, heappop, heappush
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Public license notices, by SPDX identifier.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC0-1.0": ("Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
} | {
    f"CC-{kind}-{version}": (f"Licensed under CC {kind} {version}.", f"This work is licensed under a Creative Commons {name} {version} International License.")
    for version in ("4.0", "3.0")
    for kind, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
}

#: Words that licenses are known by; cues() adds words of templates that have too few of them.
CUE = r"licen[sc]e|copyright|public domain|creative commons|permission|redistribut|free software"
#: A template is confirmed if it saves this share of what it saves on itself, and at most this share of its words differ.
SAVED, DIFFERENT = 0.3, 0.1


def bare(text: str) -> list[str]:
    return [y for x in text.lower().split() if (y := x.strip(punctuation))]


def cues(templates: Mapping[str, tuple[str, ...]]) -> str:
    """CUE and the longest words of templates, so that each template has more words with a cue than may differ."""
    found = CUE
    for text in (t for own in templates.values() for t in own):
        words = bare(text)
        lines = lambda: sum(bool(re.search(found, w)) for w in words)  # noqa: B023, E731
        for w in sorted(set(words), key=lambda w: (-len(w), w)):
            if lines() > int(DIFFERENT * len(words)):
                break
            if not re.search(found, w):
                found += "|" + re.escape(w)
    return found


def aligned(template: list[str], block: list[str]) -> tuple[int, int, int]:
    """(word edits, start, end) of the stretch of the block that the fewest edits turn into the template.

    A row of the edit table is made at once: costs are shifted left by 32 bits over the stretch's start,
    and a running least over cost - column carries insertions along the row.
    """
    n, one = len(block), 1 << 32
    codes = {w: i for i, w in enumerate(dict.fromkeys(template))}
    text = np.array([codes.get(w, -1) for w in block], dtype=np.int64)
    column = np.arange(n + 1, dtype=np.int64) * one
    above = np.arange(n + 1, dtype=np.int64)
    for w in template:
        row = above + one
        np.minimum(row[1:], above[:-1] + one * (text != codes[w]), out=row[1:])
        above = np.minimum.accumulate(row - column) + column
    end = int(np.argmin(above >> 32))
    return int(above[end] >> 32), int(above[end] & (one - 1)), end


def blocks(text: str, cue: re.Pattern, reach: int) -> Iterator[tuple[int, str]]:
    """(offset, text) around the cues: stretches of ``reach`` characters on either side, and where these meet, pieces of four times that that overlap by two."""
    low = high = -1
    for m in [*cue.finditer(text), None]:
        if m and low >= 0 and m.start() - reach <= high:
            high = min(len(text), m.end() + reach)
            continue
        if low >= 0:
            for at in range(low, max(low + 1, high - 2 * reach), 2 * reach):
                yield at, text[at : at + 4 * reach if at + 4 * reach < high else high]
        if m:
            low, high = max(0, m.start() - reach), min(len(text), m.end() + reach)


class Scanner:
    def __init__(self, templates: Mapping[str, tuple[str, ...]], level: int = 3):
        import zstandard as zstd

        self.plain, self.cue = zstd.ZstdCompressor(level=level), re.compile(cues(templates), re.IGNORECASE)
        # half as long again as the longest template, for words that are inserted and punctuation around them
        self.reach = max([2000, *(len(" ".join(t.split())) for own in templates.values() for t in own)]) * 3 // 2
        self.own, self.by_reach = [], {}
        for name, texts in templates.items():
            for text in texts:
                words = bare(text)
                raw = " ".join(words).encode()
                given = zstd.ZstdCompressor(level=level, dict_data=zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT))
                self.by_reach.setdefault(max(128, 1 << len(raw).bit_length()), []).append(len(self.own))
                self.own.append((name, words, Counter(words), given, len(self.plain.compress(raw)) - len(given.compress(raw))))

    def ranked(self, words: list[str]) -> list[tuple[float, int]]:
        """(share of its own saving, place) of the templates that save enough on some piece of the block, best first.

        Pieces are two to four times as long as the template and overlap by half.
        """
        raw, best = " ".join(words).encode(), {}
        for reach, own in self.by_reach.items():
            for at in range(0, max(1, len(raw) - reach), reach):
                piece = raw[at : at + 2 * reach]
                alone = len(self.plain.compress(piece))
                for k in own:
                    *_, given, itself = self.own[k]
                    share = (alone - len(given.compress(piece))) / itself
                    if share >= SAVED and share > best.get(k, 0):
                        best[k] = share
        return sorted(((v, k) for k, v in best.items()), key=lambda x: (-x[0], x[1]))

    def stated(self, words: list[str]) -> Iterator[tuple[float, int, str, float, int]]:
        """(share of different words, -template words, license, saved share, different words) of each stretch of a block that states a license.

        Of templates whose stretches overlap, the closest wins, then the longest. The winner and those that lose are
        aligned again on what is left of the block, until no stretch there is close enough.
        """
        free: list[tuple[int, int]] = [(0, len(words))]
        has: dict[tuple[int, int], Counter] = {}
        found: dict[tuple[int, int, int], tuple[int, int, int]] = {}

        def closest(share: float, k: int) -> list[tuple]:
            name, template, need, *_ = self.own[k]
            most, places = int(DIFFERENT * len(template)), []
            for low, high in free:
                if high - low < len(template) - most:
                    continue
                if (k, low, high) not in found:
                    if (low, high) not in has:
                        has[low, high] = Counter(words[low:high])
                    n, start, end = len(template), 0, 0
                    if sum((need - has[low, high]).values()) <= most:  # words that aren't there are different at least
                        n, start, end = aligned(template, words[low:high])
                    found[k, low, high] = (n, low + start, low + end)
                if found[k, low, high][0] <= most:
                    places.append(found[k, low, high])
            return [(at[0] / len(template), -len(template), name, share, *at, k) for at in sorted(places)[:1]]

        heap = [x for share, k in self.ranked(words) for x in closest(share, k)]
        heapify(heap)
        while heap:
            *stretch, start, end, k = heappop(heap)
            for i, (low, high) in enumerate(free):
                if low <= start and end <= high:
                    free[i : i + 1] = [x for x in ((low, start), (end, high)) if x[0] < x[1]]
                    yield tuple(stretch)
                    break
            for x in closest(stretch[3], k):
                heappush(heap, x)

    def scan(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(license, saved share, template words, different words, block's offset in the text with white space made single), one for each license."""
        best: dict[str, tuple[float, int, int, int]] = {}
        text = " ".join(text.split())  # white space of any length counts as one character
        for offset, block in blocks(text, self.cue, self.reach):
            for ratio, minus, name, share, n in self.stated(bare(block)):
                if name not in best or (ratio, minus, offset) < (best[name][2] / best[name][1], -best[name][1], best[name][3]):
                    best[name] = (round(share, 4), -minus, n, offset)
        return [(k, *v) for k, v in sorted(best.items())]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """(id, license, saved, n_words, n_different, offset) for every license that a document states."""
    rows = docs.select(id_col, text_col).where(F.col(text_col).rlike(f"(?i){cues(templates)}"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for b in batches:
            hits = [(row, *x) for row, t in enumerate(b.column(1)) for x in scanner.scan(t.as_py())]
            if hits:
                row, *cols = zip(*hits, strict=True)
                kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["i", "l", "s", "w", "d", "o"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, license string, saved double, n_words bigint, n_different bigint, offset bigint")
