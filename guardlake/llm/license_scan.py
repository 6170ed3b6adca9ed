"""License notices in texts by conditional compression.

Lines with a license word form candidate blocks (``WORDS``; two such lines with at most
two others between are one block). In and around a block, windows of each template's own
length are compressed alone and with every template as a raw zstandard dictionary: the more
wording a window shares with a template, the more bytes the dictionary saves. Pairs of
window and template are ranked by the bytes saved, and confirmed in that order by their
wording: the template's words are aligned with those of the window and around it, and the words that differ are
counted. A template is found if at most a tenth of its words is missing and not more
words are added; ``exact`` says that none differ. Placeholders (year, holder) match any
words. Of notices that overlap, the one that has saved the most bytes is reported, less
``WORD_BYTES`` for each word that differs; a template that saves nothing is never found.

So few differences leave a run of template words whole whose length follows from the
template's. An index of such runs says at which places of a line of any length a template
could be confirmed at all, and so which windows are worth compressing and when to stop.

The reduction is that of the notice's own words, ``runner_up`` the template of another
license that shrinks them most. A block without a notice has the highest reduction of
its windows with a license word (twice the longest template, overlapping by half).

Only texts with a license word leave the JVM; no row moves.

Defined results: a null or empty text has no blocks; case, punctuation and line breaks do
not count as wording; ties in reduction go to the template first in the list; a block
that no template explains is reported with a null license; repeated rows give repeated
results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardlake.llm.shared import in_arrow

#: Words of which at least one is in every line of a block's ends, letters in either case.
WORDS = r"licen[cs]|copyright|warrant|redistribut|permission|public domain|without restriction|merchantab"

ANY = "<any>"
#: Notices as their licenses word them. ``<any>`` stands for a year, a holder or the like.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither
the name of <any> nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission."""),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"""),
    ("BSL-1.0", """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at
http://www.boost.org/LICENSE_1_0.txt)"""),
    ("EPL-2.0", """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/"""),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

TOKEN = re.compile(r"[^\W_]+(?:\.\d+)*|" + ANY)
GAP = 2
#: Bytes that a word that differs takes off what a template has saved.
WORD_BYTES = 2
SCHEMA = ("doc_id {kind}, start int, end int, license string, template int, reduction double, "
          "missing int, added int, exact boolean, runner_up string")


def tokens(text: str) -> list[tuple[str, int, int]]:
    """Words with their places, lower-cased."""
    return [(m.group().lower(), m.start(), m.end()) for m in TOKEN.finditer(text)]


class Matcher:
    """The templates in one task: their words, and a compressor with each as dictionary."""

    def __init__(self, templates: tuple) -> None:
        self.names = [name for name, _ in templates]
        self.words = [[w for w, _, _ in tokens(text)] for _, text in templates]
        self.most = max(map(len, self.words))
        self.alone = zstandard.ZstdCompressor(level=19, write_content_size=False, write_dict_id=False)
        self.given = [zstandard.ZstdCompressor(level=19, write_content_size=False, write_dict_id=False, dict_data=zstandard.ZstdCompressionDict(
            " ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for words in self.words]
        self.line = re.compile(WORDS, re.IGNORECASE)
        #: Per length, runs of template words and where they stand. A confirmed notice has at least one run of its template.
        self.runs: dict[int, dict[tuple, list[tuple[int, int]]]] = {}
        self.slack = []
        for i, words in enumerate(self.words):
            differ, free = len(words) // 10, words.count(ANY)
            run = max(-(-(len(words) - free - differ) // (2 * differ + free + 1)), 1)
            of = self.runs.setdefault(run, {})
            for at in range(len(words) - run + 1):
                if ANY not in words[at:at + run]:
                    of.setdefault(tuple(words[at:at + run]), []).append((i, at))
            self.slack.append(len(words) + 8 if free else differ)
        self.reach = max(len(words) + slack for words, slack in zip(self.words, self.slack))

    def blocks(self, text: str) -> list[tuple[int, int]]:
        """Places of the candidate blocks, whole lines."""
        out: list[list[int]] = []
        at = 0
        for number, line in enumerate(text.split("\n")):
            if self.line.search(line):
                if out and number - out[-1][2] <= GAP + 1:
                    out[-1][1:] = [at + len(line), number]
                else:
                    out.append([at, at + len(line), number])
            at += len(line) + 1
        return [(a, b) for a, b, _ in out]

    def ranked(self, words: list[str]) -> list[tuple[float, int]]:
        """Templates by how much their text shrinks the compressed block."""
        data = " ".join(words).encode()
        size = len(self.alone.compress(data))
        return sorted(((1 - len(c.compress(data)) / size, i) for i, c in enumerate(self.given)), key=lambda x: (-x[0], x[1]))

    def wording(self, template: int, words: list[str]) -> tuple[int, int, int, int] | None:
        """(first, last, missing, added): where the template's words stand among some words, and what differs."""
        wanted = self.words[template]
        runs = [m for m in SequenceMatcher(None, wanted, words, autojunk=False).get_matching_blocks() if m.size]
        while runs and runs[-1].b + runs[-1].size - runs[0].b > 2 * len(wanted) + 8:  # a stray word far off
            runs = runs[1:] if runs[0].size <= runs[-1].size else runs[:-1]
        if not runs:
            return None
        first, last = runs[0].b, runs[-1].b + runs[-1].size
        missing, added = runs[0].a + len(wanted) - runs[-1].a - runs[-1].size, 0
        for x, y in zip(runs, runs[1:]):
            lost, new = wanted[x.a + x.size:y.a], y.b - x.b - x.size
            if ANY in lost:
                lost, new = [w for w in lost if w != ANY], 0
            missing, added = missing + len(lost), added + new
        return first, last, missing, added

    def windows(self, words: list[str], low: int, high: int) -> list[tuple[int, int, int]]:
        """(template, first start, last start) of the windows, each of its template's length, that share a whole run with it.

        Starts of one template that lie within half its length are one window: a placeholder or a lost
        word shifts the runs behind it.
        """
        starts: dict[int, set[int]] = {}
        for size, runs in self.runs.items():
            for at in range(low, high - size + 1):
                for i, begun in runs.get(tuple(words[at:at + size]), ()):
                    starts.setdefault(i, set()).add(at - begun)
        out = []
        for i, begun in starts.items():
            near, first, last = min(len(self.words[i]) // 10 + 8, len(self.words[i]) // 2), None, 0
            for at in sorted(begun):
                if first is not None and at - last <= near and at - first <= len(self.words[i]) // 2:
                    out[-1] = (i, first, at)
                else:
                    first = at
                    out.append((i, at, at))
                last = at
        return out

    def hits(self, words: list[str], low: int, high: int) -> list[tuple]:
        """Notices among words low to high, in the order in which compression ranks them; a later one may overlap an earlier.

        Each window is compressed alone and with each template. Pairs of window and template stand by the bytes that
        the template saves, and are confirmed by wording in that order; a template that saves none is not confirmed.
        Templates without a whole run in the window cannot be confirmed there and are passed over: with them gone through,
        no remaining template could be. A word that differs counts against the bytes saved, for one digit (version 2 or 3) may
        cost none. Each hit is (rank, first, template, last, missing, added).
        """
        places = self.windows(words, low, high)
        spans = [(max(first, low), min(last + len(self.words[i]), high)) for i, first, last in places]
        ranks = {span: {i: saved for saved, i in self.saving(words[span[0]:span[1]])} for span in set(spans)}
        order = sorted((-ranks[span].get(i, 0), first, i, last) for span, (i, first, last) in zip(spans, places))
        out = []
        for saved, begun, i, last in order:
            if saved >= 0:
                break
            size, slack = len(self.words[i]), self.slack[i]
            around = max(begun - slack, low)
            w = self.wording(i, words[around:min(last + size + slack, high)])
            if w and 10 * w[2] <= size and 10 * w[3] <= size:
                out.append((saved + WORD_BYTES * (w[2] + w[3]), around + w[0], i, around + w[1], w[2], w[3]))
        return sorted(out)

    def saving(self, words: list[str]) -> list[tuple[int, int]]:
        """Templates by the bytes that they save of the words' compressed size."""
        data = " ".join(words).encode()
        size = len(self.alone.compress(data))
        return [(round(reduction * size), i) for reduction, i in self.ranked(words)]

    def unexplained(self, text: str, all_words: list, low: int, high: int) -> tuple[float, int]:
        """(reduction, template) of the window with a license word that any template shrinks most; windows overlap by half."""
        best = None
        for at in range(low, max(high - self.most, low + 1), self.most):
            window = all_words[at:min(at + 2 * self.most, high)]
            if high - low <= 2 * self.most or self.line.search(text, window[0][1], window[-1][2]):
                reduction, i = self.ranked([w for w, _, _ in window])[0]
                if best is None or (-reduction, i) < (-best[0], best[1]):
                    best = reduction, i
        return best or self.ranked([w for w, _, _ in all_words[low:high]])[0]

    def found(self, text: str) -> Iterator[tuple]:
        """(start, end, template or None, reduction, missing, added, runner-up) for each block; a block may hold several notices."""
        if not self.line.search(text):
            return
        all_words = tokens(text)
        words, starts = [w for w, _, _ in all_words], [a for _, a, _ in all_words]
        done = 0
        for begin, end in self.blocks(text):
            low, high = max(bisect_left(starts, begin), done), bisect_left(starts, end)
            if low >= high:
                continue
            taken: list[tuple] = []  # by place; none overlap
            for hit in self.hits(words, max(low - self.reach, done), min(high + self.reach, len(words))):
                _, first, _, last, _, _ = hit
                at = bisect_left(taken, first, key=lambda h: h[1])
                free = (at == 0 or taken[at - 1][3] <= first) and (at == len(taken) or last <= taken[at][1])
                if free and first < high and low < last:
                    taken.insert(at, hit)
            for _, first, i, last, missing, added in taken:
                ranks = self.ranked(words[first:last])
                second = next((self.names[j] for _, j in ranks if self.names[j] != self.names[i]), None)
                yield starts[first], all_words[last - 1][2], i, next(r for r, j in ranks if j == i), missing, added, second
                done = last
            if not taken:
                reduction, i = self.unexplained(text, all_words, low, high)
                yield starts[low], all_words[high - 1][2], None, reduction, None, None, self.names[i]


_MATCHERS: dict[tuple, Matcher] = {}


def scan(docs: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """Per notice or unexplained block: doc_id, start, end (code points), license, template, reduction, missing, added, exact, runner_up."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if templates not in _MATCHERS:
            _MATCHERS[templates] = Matcher(templates)
        use = _MATCHERS[templates]
        for batch in batches:
            ids, out = [], [[] for _ in range(9)]
            for row, text in enumerate(batch.column("text").to_pylist()):
                for start, end, i, reduction, missing, added, second in use.found(text):
                    ids.append(row)
                    for column, value in zip(out, (start, end, None if i is None else use.names[i], i, reduction, missing, added,
                                                   i is not None and missing == 0 and added == 0, second)):
                        column.append(value)
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids, pa.int64())), *(pa.array(c, t) for c, t in zip(out, kinds))], names=[
                "doc_id", "start", "end", "license", "template", "reduction", "missing", "added", "exact", "runner_up"])

    likely = docs.select("doc_id", "text").filter(F.col("text").rlike(f"(?i){WORDS}"))
    return in_arrow(likely, run, SCHEMA.format(kind=kind))
