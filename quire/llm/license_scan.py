"""License scans: template markup compiled into token automata.

A template is wording with markup: <<beginOptional>> ... <<endOptional>> holds words that may be
left out, <<var;words=a..b>> stands for a to b words of any kind. Everything else is mandatory and must
match word by word. A template becomes a nondeterministic automaton over words, run from every place
where it can begin; the longest accepted stretch counts.

Words are runs of characters other than ASCII non-alphanumerics, after lower-casing A-Z, so
punctuation, case and line breaks never matter.

Base phrases are found beside the templates, at every place where their words stand in a row.

Defined cases: a null or empty text has no words, labels "" and score 0; overlapping hits of
different templates all count; hits of one template do not overlap; repeated rows are judged alike;
an empty table stays empty; columns of df are kept and those named like results replaced.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import LOWER, UPPER, fresh

# The base phrases and their labels.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Published license wording to its end, with optional and replaceable regions marked. The long license
# texts themselves (Apache, GPL) have no template; their notices, lines and names are found.
TEMPLATES = (
    ("mit-text", 1.0, """
<<beginOptional>>The <<endOptional>><<beginOptional>>MIT License<<beginOptional>> (MIT)<<endOptional>><<endOptional>>
<<beginOptional>>Copyright <<beginOptional>>(c) <<endOptional>><<var;words=1..12>><<beginOptional>> All rights reserved.<<endOptional>><<endOptional>>
Permission is hereby granted, free of charge, to any person obtaining a copy of <<beginOptional>>this<<endOptional>><<var;words=0..4>>
and <<beginOptional>>associated documentation <<endOptional>><<beginOptional>>files<<endOptional>><<beginOptional>> (the "Software")<<endOptional>>,
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph) <<endOptional>>shall be
included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
<<var;words=2..12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc-text", 1.0, """
Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or
without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND <<var;words=1..6>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;words=1..6>> BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd-text", 1.0, """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: <<beginOptional>>1. <<endOptional>>Redistributions of source code must retain the above
copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2. <<endOptional>>Redistributions in
binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution. <<beginOptional>><<beginOptional>>3. <<endOptional>>Neither
the name of <<var;words=1..15>> nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission. <<endOptional>>THIS SOFTWARE IS PROVIDED BY <<var;words=1..12>> "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS
FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;words=1..12>> BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("apache-notice", 1.0, """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this <<var;words=1..3>> except in compliance
with the License. You may obtain a copy of the License at <<var;words=3..10>> Unless required by applicable law or agreed
to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License."""),
    ("gpl-notice", 1.0, """
<<var;words=1..4>> is free software: you can redistribute it and/or modify it under the terms of the GNU
<<beginOptional>>Lesser <<endOptional>><<beginOptional>>Affero <<endOptional>>General Public License as published by
the Free Software Foundation, either version <<var;words=1..2>> of the License, or (at your option) any later version.
<<var;words=1..4>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU <<beginOptional>>Lesser <<endOptional>><<beginOptional>>Affero
<<endOptional>>General Public License for more details. You should have received a copy of the GNU <<beginOptional>>Lesser
<<endOptional>><<beginOptional>>Affero <<endOptional>>General Public License along with <<var;words=1..4>> If not, see
<<var;words=1..1>> www gnu org licenses."""),
    ("mit-line", 0.9, """<<beginOptional>>This <<var;words=1..3>> is <<endOptional>>released under
the <<beginOptional>>terms of the <<endOptional>>MIT License<<beginOptional>>.<<endOptional>>"""),
    ("apache-2.0-line", 0.9, """Licensed under the <<beginOptional>>terms of the <<endOptional>>Apache
License<<beginOptional>>,<<endOptional>> <<beginOptional>>Version <<endOptional>>2.0"""),
    ("gpl-line", 0.9, """<<beginOptional>>This <<var;words=1..3>> is <<endOptional>>licensed under the <<beginOptional>>terms of
the <<endOptional>><<beginOptional>>GNU <<endOptional>><<beginOptional>>Lesser <<endOptional>>General Public
License<<beginOptional>>, version <<var;words=1..1>><<endOptional>>"""),
    ("cc-by-nc", 0.9, """Licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>Creative Commons
<<endOptional>>CC BY-NC<<beginOptional>>-<<endOptional>><<beginOptional>>SA<<endOptional>><<beginOptional>>ND<<endOptional>> <<var;words=1..2>>"""),
)

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MARK = re.compile(r"<<(beginOptional|endOptional|var;words=(\d+)\.\.(\d+))>>")
ANY = None


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))


class Automaton:
    """States are numbers; steps[s] lists (word or ANY, next), skips[s] lists free moves."""

    def __init__(self, label: str, weight: float, template: str):
        self.label, self.weight = label, weight
        self.steps: list[list] = [[]]
        self.skips: list[list[int]] = [[]]
        state, opened, at, run, self.anchor = 0, [], 0, [], b""
        for mark in [*_MARK.finditer(template), None]:
            for word in words_of(template[at : mark.start() if mark else None]):
                state = self._step(state, word)
                if not opened:
                    run.append(word)
                    self.anchor = max(self.anchor, b" ".join(run), key=len)
            if mark is None:
                break
            at = mark.end()
            if mark[1] == "beginOptional":
                opened.append(state)
            elif mark[1] == "endOptional":
                state = self._step(state, None, free=True)
                self.skips[opened.pop()].append(state)
            else:
                low, high = int(mark[2]), int(mark[3])
                first = []
                for k in range(high):
                    if k >= low:
                        first.append(state)
                    state = self._step(state, ANY)
                state = self._step(state, None, free=True)
                for s in first:
                    self.skips[s].append(state)
            run = []  # what an optional or replaceable region parts is not one anchor
        self.final = state
        self.closures = [self._closure({s}) for s in range(len(self.steps))]
        self._moves: dict = {}

    def _step(self, state: int, word: bytes | None, free: bool = False) -> int:
        self.steps.append([])
        self.skips.append([])
        new = len(self.steps) - 1
        if free:
            self.skips[state].append(new)
        else:
            self.steps[state].append((word, new))
        return new

    def _closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def move(self, states: frozenset[int], word: bytes) -> frozenset[int]:
        word = word if any(w == word for s in states for w, _ in self.steps[s]) else b""
        key = (states, word)
        if key not in self._moves:
            to = [n for s in states for w, n in self.steps[s] if w is ANY or w == word]
            self._moves[key] = frozenset().union(*(self.closures[n] for n in to)) if to else frozenset()
        return self._moves[key]

    def spans(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Longest accepted stretches [start, end) from left to right, without overlap."""
        start = self.closures[0]
        begins = {w for s in start for w, _ in self.steps[s]}
        out, at = [], 0
        while at < len(words):
            if ANY not in begins and words[at] not in begins:
                at += 1
                continue
            states, end, k = start, -1, at
            while states and k < len(words):
                states = self.move(states, words[k])
                k += 1
                if self.final in states:
                    end = k
            if end > at:
                out.append((at, end))
                at = end
            else:
                at += 1
        return out


class Scanner:
    """Templates and base phrases, ready to scan word lists."""

    def __init__(self, templates=TEMPLATES, phrases=BASE_PHRASES):
        self.automata = [Automaton(*t) for t in templates]
        self.phrases = [(tuple(words_of(p)), label) for p, label in phrases]

    def scan(self, text: str | None) -> tuple[int, list, list]:
        """Number of words, base places (label, start) and template hits (label, start, end, weight)."""
        words = words_of(text)
        line = b" " + b" ".join(words) + b" "
        places = []
        for phrase, label in self.phrases:
            if b" " + b" ".join(phrase) + b" " in line:
                at = 0
                while True:
                    try:
                        at = words.index(phrase[0], at)
                    except ValueError:
                        break
                    if tuple(words[at : at + len(phrase)]) == phrase:
                        places.append((label, at))
                    at += 1
        hits = [
            (a.label, start, end, a.weight)
            for a in self.automata
            if b" " + a.anchor + b" " in line
            for start, end in a.spans(words)
        ]
        return len(words), places, hits


RESULT = (
    "n_words long, base array<struct<label:string,start:long>>, "
    "hits array<struct<label:string,start:long,end:long,weight:double>>"
)


def _scan(templates, phrases):
    def scan(texts: pd.Series) -> pd.DataFrame:
        scanner = Scanner(templates, phrases)
        rows = []
        for t in texts:
            n, places, hits = scanner.scan(t)
            rows.append((
                n,
                [{"label": a, "start": b} for a, b in places],
                [{"label": a, "start": b, "end": c, "weight": d} for a, b, c, d in hits],
            ))
        return pd.DataFrame(rows, columns=["n_words", "base", "hits"])

    return F.pandas_udf(scan, RESULT)


def scan_licenses(df: DataFrame, text: str = "text", templates=TEMPLATES, phrases=BASE_PHRASES) -> DataFrame:
    """Add n_words, base (places of phrases) and hits (stretches of templates) to df."""
    keep = [F.col(f"`{c}`") for c in df.columns if c not in ("n_words", "base", "hits")]
    own = fresh(df.columns, "_scan")
    scanned = df.withColumn(own, _scan(templates, phrases)(F.col(f"`{text}`")))
    return scanned.select(*keep, f"{own}.n_words", f"{own}.base", f"{own}.hits")


def joined_labels(*labels: Column) -> Column:
    """Distinct labels of arrays of structs, sorted and joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.concat(*labels))), ",")


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """One flat row per document. A template hit scores its weight, base phrases alone 0.5."""
    places = F.col("base.start")
    best = F.array_max(F.col("hits.weight"))
    return scanned.select(
        key,
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        joined_labels(F.col("base.label")).alias("base_labels"),
        joined_labels(F.col("base.label"), F.col("hits.label")).alias("labels"),
        F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.size("base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
