"""Licence scans: normalised text against licence templates by the Dice coefficient of word bigrams.

Only words count, so line ends, indents and the marks of comments make no difference. Units of a text are,
for templates of LONG bigrams or more, runs of words wherever they begin and end, and for all templates its
paragraphs (runs of lines with a word), lines and sentences, also those that go on over line ends.
A unit can only reach the threshold t against a template if its number of bigrams lies
between t / (2 - t) and (2 - t) / t times the template's; all other templates are passed over
unseen, and units that fit none aren't compared at all. As a unit holds t / (2 - t) of the
template's bigrams then, a text that doesn't hold so many of any template has no hits.

A run reaches t if (2 - t) times its bigrams of the template less t times its others come to t times the
template's size, so runs are found in one pass over the words that keeps the greatest such sum.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

THRESHOLD = 0.8

# Wording of well-known notices that name a licence; the licences themselves are the files in licence_texts.
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
NOTICES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (_APACHE, "Licensed under the Apache License, Version 2.0."),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.",),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "GPL-3.0": (_GPL, "This work is licensed under the GNU General Public License, version 3."),
    "ISC": ("Released under the ISC License.",),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}


def _templates() -> dict[str, tuple[str, ...]]:
    """The notices and whole licence texts of each licence."""
    found = dict(NOTICES)
    for path in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
        found[path.stem] = (*found.get(path.stem, ()), path.read_text(encoding="utf-8"))
    return found


TEMPLATES = _templates()

_WORD = re.compile(r"[^\W_]+")
_LINE = re.compile(r"[^\r\n]+")
_BREAK = re.compile(r"\r\n|\r|\n")
_TAIL = re.compile(r"[^\w\s]*")
_SENTENCE = re.compile(r"\S.*?(?:[.!?](?=\s|$)|$)", re.DOTALL)
#: Bigrams from which a template is looked for in runs of words; lines at both ends of a run that may be left off, and words that may be added.
LONG, ENDS, MORE = 24, 6, 12


def bigrams(text: str) -> frozenset[tuple[str, str]]:
    """Distinct pairs of neighbouring words of a text, in lower case, without punctuation."""
    words = _WORD.findall(text.lower())
    return frozenset(zip(words, words[1:]))


def dice(a: frozenset, b: frozenset) -> float:
    """Twice the common bigrams over the bigrams of both; 0 where both are empty."""
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


class Templates:
    """Templates by size, so that those in a range of sizes are found by bisection."""

    def __init__(self, templates: dict[str, tuple[str, ...]], threshold: float):
        self.threshold, self.ratio = threshold, threshold / (2 - threshold)
        rows = sorted(((len(b), name, b) for name, texts in templates.items() for b in map(bigrams, texts) if b), key=lambda r: r[:2])
        self.sizes, self.rows = [r[0] for r in rows], rows
        self.most = max(self.sizes, default=0) / self.ratio
        self.holders: dict[tuple[str, str], list[int]] = {}
        for i, row in enumerate(rows):
            for pair in row[2]:
                self.holders.setdefault(pair, []).append(i)

    def candidates(self, text: str) -> list[int]:
        """The templates of which a text holds as many bigrams as a unit needs at least."""
        words = _WORD.findall(text.lower())
        held = Counter(i for pair in self.holders.keys() & set(zip(words, words[1:])) for i in self.holders[pair])
        return sorted(i for i, n in held.items() if n >= self.ratio * self.sizes[i] - 1e-9)

    def _windows(self, pairs: list[tuple[str, str]], template: frozenset) -> list[tuple[int, int]]:
        """First and last place of the runs of pairs whose sum for the template is greatest and great enough, in order.

        Pairs that a run has already count nothing. A run ends where its sum is used up, or where it hasn't
        grown for the template's length; what comes after its greatest sum is looked at anew.
        """
        gain, loss, need, patience = 2 - self.threshold, self.threshold, self.threshold * len(template) - 1e-9, len(template)
        out, last, k, n = [], {}, 0, len(pairs)
        start, total, top, end = 0, 0.0, 0.0, 0
        while True:
            if k < n:
                pair = pairs[k]
                if last.get(pair, -1) < start:
                    total += gain if pair in template else -loss
                last[pair] = k
                if total > top:
                    top, end = total, k
            if k >= n or total <= 0 or (top >= need and k - end > patience):
                if top >= need:
                    out.append((start, end))
                    k = end
                elif k >= n:
                    return out
                start, total, top = k + 1, 0.0, 0.0
                last = {}
            k += 1

    def _trimmed(self, pairs: list, template: frozenset, start: int, end: int, lines: list[int]) -> tuple[float, int, int]:
        """A run's Dice coefficient, start and end, without those of its outer lines that lower it (ties: the shortest)."""
        def nearness(a: int, b: int) -> float:
            return dice(frozenset(pairs[a : b + 1]), template)

        firsts = lines[bisect.bisect_right(lines, start) :][:ENDS]
        start = max([start, *(a for a in firsts if a <= end)], key=lambda a: (round(nearness(a, end), 9), a))
        lasts = [a - 2 for a in lines[: bisect.bisect_right(lines, end + 1)][-ENDS:]]
        end = max([end, *(b for b in lasts if b >= start)], key=lambda b: (round(nearness(start, b), 9), -b))
        return nearness(start, end), start, end

    def runs(self, text: str, among: list[int]) -> list[tuple[int, int, str, float]]:
        """(start, end, licence, dice) of the runs of words that match a long template, apart from each other.

        Of runs that overlap, the one of the largest template stays, then the nearest, then the shortest.
        """
        words = [(m[0].lower(), *m.span()) for m in _WORD.finditer(text)]
        pairs = [(a[0], b[0]) for a, b in zip(words, words[1:])]
        starts = [w[1] for w in words]
        lines = sorted({bisect.bisect_left(starts, m.end()) for m in _BREAK.finditer(text)})
        found = []
        for i in among:
            size, _, template = self.rows[i]
            if size < LONG:
                continue
            ways = self._windows(pairs, template)
            ways += [(len(pairs) - 1 - b, len(pairs) - 1 - a) for a, b in self._windows(pairs[::-1], template)]
            for a, b in set(ways):  # pairs that the run has already end it without a sum: a few more words of the template go with it
                b = next((k for k in range(b, min(b + MORE, len(pairs) - 1)) if pairs[k + 1] not in template), min(b + MORE, len(pairs) - 1))
                a = next((k for k in range(a, max(a - MORE, 0), -1) if pairs[k - 1] not in template), max(a - MORE, 0))
                _, a, b = self._trimmed(pairs, template, a, b, lines)
                own = frozenset(pairs[a : b + 1])
                d, j = max((round(dice(own, self.rows[j][2]), 12), -j) for j in among)  # the nearest of all, whichever it was looked for
                if d >= self.threshold:
                    found.append((-self.rows[-j][0], -d, b - a, a, b, self.rows[-j][1]))
        chosen: list[tuple[int, int, str, float]] = []
        taken: list[tuple[int, int]] = []
        for _, d, _, a, b, name in sorted(found):
            if all(b + 1 < x or y + 1 < a for x, y in taken):
                taken.append((a, b))
                end = words[b + 1][2]
                chosen.append((words[a][1], end + len(_TAIL.match(text, end)[0]), name, -d))
        return sorted(chosen)

    @staticmethod
    def paragraphs(text: str) -> list[tuple[int, int]]:
        """Runs of neighbouring lines that have a word, whatever the line ends."""
        out: list[list[int]] = []
        for m in _LINE.finditer(text):
            if _WORD.search(m[0]):
                if out and _BREAK.fullmatch(text, out[-1][1], m.start()):
                    out[-1][1] = m.end()
                else:
                    out.append(list(m.span()))
        return [tuple(p) for p in out]

    def best(self, text: str) -> tuple[str, float] | None:
        """The template nearest to a unit, and its Dice coefficient, if it reaches the threshold."""
        words = _WORD.findall(text.lower())
        found = frozenset(zip(words, words[1:]))
        n, top = len(found), None
        for i in range(bisect.bisect_left(self.sizes, n * self.ratio - 1e-9), bisect.bisect_right(self.sizes, n / self.ratio + 1e-9)):
            _, name, b = self.rows[i]
            d = dice(found, b)
            if d >= self.threshold and (top is None or d > top[1]):
                top = name, d
        return top

    def _within(self, text: str, start: int, end: int) -> list[tuple[int, int, str, float]]:
        """Hits of a paragraph's lines and sentences; one that goes on over line ends stays where it is nearer than those in it."""
        hits, covered = [], -1
        for line in _LINE.finditer(text, start, end):
            for a, b in (line.span(), *(s.span() for s in _SENTENCE.finditer(text, *line.span()))):
                if a >= covered and (top := self.best(text[a:b])) is not None:
                    hits.append((a, b, *top))
                    covered = b
        for s in _SENTENCE.finditer(text, start, end):
            if _BREAK.search(s[0]) and (top := self.best(s[0])) is not None:
                inside = [h for h in hits if h[0] < s.end() and s.start() < h[1]]
                if all(h[3] < top[1] for h in inside):
                    hits = sorted([h for h in hits if h not in inside] + [(*s.span(), *top)])
        return hits

    def scan(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, licence, dice) of the units that reach the threshold, in order.

        Of units that overlap the larger stays, so a whole licence text is reported once.
        """
        among = self.candidates(text)
        if not among:
            return []
        hits = self.runs(text, among)
        found, at = list(hits), 0
        for a, b in self.paragraphs(text):
            while at < len(hits) and hits[at][1] <= a:
                at += 1
            inside = [h for h in hits[at:] if h[0] < b] if at < len(hits) and hits[at][0] < b else []
            if not inside and (top := self.best(text[a:b])) is not None:
                found.append((a, b, *top))
                continue
            for h in [*inside, (b, b)]:  # what the runs leave of it
                if a < h[0]:
                    found.extend(self._within(text, a, h[0]))
                a = max(a, h[1])
        return sorted(found)


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """Add ``licenses``: array of (start, end, license, dice) for each document; other columns stay.

    Whole texts are read. Null and empty texts have an empty array. Places are code points, end
    exclusive. A column named ``licenses`` is replaced.
    """
    kept = docs.drop("licenses").schema.fields
    names = [f.name for f in kept]
    found = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("license", T.StringType()), T.StructField("dice", T.DoubleType())]))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("license", pa.string()), ("dice", pa.float64())]))
    chosen = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Templates(chosen, threshold)
        for batch in batches:
            hits = [[dict(zip(("start", "end", "license", "dice"), h)) for h in index.scan(t.as_py() or "")] for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(hits, kind)], [*names, "licenses"])

    return docs.drop("licenses").mapInArrow(run, T.StructType([*kept, T.StructField("licenses", found)]))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_hits, best (greatest Dice), licenses (distinct names) and spans of each document."""
    hits = F.col("licenses")
    return scan(docs.select(F.col("doc_id").cast("long"), "text")).select(
        "doc_id",
        F.size(hits).cast("long").alias("n_hits"),
        F.coalesce(F.array_max(F.transform(hits, lambda h: h["dice"])), F.lit(0.0)).alias("best"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["license"]))), ",").alias("licenses"),
        F.array_join(F.transform(hits, lambda h: F.concat_ws(":", h["license"], h["start"].cast("string"), h["end"].cast("string"))), ",").alias("spans"),
    )
