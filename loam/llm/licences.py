"""Licence scans: matching statistics of texts against a generalised suffix automaton of licence templates, chained into template spans."""

from __future__ import annotations

import pkgutil
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import table

#: Phrases that give a label wherever their words stand consecutively. Fixed values.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Statements of which a text has to hold most words, in order.
STATEMENTS = [
    ("released under the mit license", "mit"),
    ("this project is available under the terms of the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("this file is made available under the apache license 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("available under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("available under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this work is licensed under the gnu general public license version 2", "gpl-2"),
    ("this work is licensed under the gnu lesser general public license version 3", "lgpl-3"),
    ("this code is subject to the terms of the mozilla public license version 2 0", "mpl-2"),
    ("released under a three clause bsd license", "bsd-3"),
    ("released under a two clause bsd license", "bsd-2"),
    ("dedicated to the public domain under the cc0 1 0 universal dedication", "cc0"),
]
_WARRANTY = "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the {0} for more details"
_GNU = "{0} is free software you can redistribute it and or modify it under the terms of the {1} as published by the free software foundation either version {2} of the license or at your option any later version " + _WARRANTY.replace("{0}", "{1}")
_GPL, _LGPL = "gnu general public license", "gnu lesser general public license"
#: What the files of a work say at their head.
HEADERS = [
    (_GNU.format("this program", _GPL, "3"), "gpl-3"),
    (_GNU.format("this program", _GPL, "2"), "gpl-2"),
    (_GNU.format("this library", _LGPL, "3").replace("this program is", "this library is"), "lgpl-3"),
    (_GNU.format("this library", _LGPL, "2 1").replace("this program is", "this library is"), "lgpl-2.1"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "apache-2"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "mpl-2"),
]
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution {0}this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
#: Whole licences: short ones here, long ones in the folder licence_texts.
BODIES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "mit"),
    (_BSD.format("3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission "), "bsd-3"),
    (_BSD.format(""), "bsd-2"),
    *((pkgutil.get_data("loam.llm", f"licence_texts/{x}.txt").decode(), x) for x in ("apache-2", "gpl-2", "gpl-3", "lgpl-2.1", "lgpl-3", "mpl-2", "cc0")),
]
TEMPLATES = STATEMENTS + HEADERS + BODIES
#: A byte of a word stays, A-Z in lower case; others part words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Automaton:
    """The suffix automaton of several word sequences: a state stands for the substrings that end at the same places of these."""

    def __init__(self, sequences: list[list[bytes]]) -> None:
        self.length, self.link, self.next = [0], [-1], [{}]
        path = [self._insert(s) for s in sequences]
        #: Of each state the (sequence, end) at which its substrings end.
        self.ends: list[set[tuple[int, int]]] = [set() for _ in self.length]
        for i, states in enumerate(path):
            for end, s in enumerate(states, 1):
                self.ends[s].add((i, end))
        for s in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            self.ends[self.link[s]] |= self.ends[s] if self.link[s] else set()

    def _state(self, length: int, link: int, then: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(then)
        return len(self.length) - 1

    def _split(self, p: int, word: bytes) -> int:
        """The state of the substrings of p with the word behind, apart from longer ones."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _insert(self, sequence: list[bytes]) -> list[int]:
        last = 0
        for word in sequence:
            if word in self.next[last]:
                last = self._split(last, word)
                continue
            new = self._state(self.length[last] + 1, 0, {})
            p = last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, word)
            last = new
        states, s = [], 0
        for word in sequence:
            s = self.next[s][word]
            states.append(s)
        return states

    def statistics(self, words: list[bytes]) -> list[tuple[int, int]]:
        """At each word, the length of the longest substring of any sequence that ends there, and its state."""
        found, s, n = [], 0, 0
        for word in words:
            while s and word not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if word in self.next[s]:
                s, n = self.next[s][word], n + 1
            else:
                s = n = 0
            found.append((n, s))
        return found


class Scanner:
    def __init__(self, phrases: list[tuple[str, str]], templates: list[tuple[str, str]], least: int, gap: int, covered: float) -> None:
        self.least, self.gap, self.covered = least, gap, covered
        given = [(words_of(t.encode()), label, True) for t, label in phrases] + [(words_of(t.encode()), label, False) for t, label in templates]
        self.sequences = [x for x in given if x[0]]
        self.automaton = a = Automaton([x[0] for x in self.sequences])
        self.words = {w for x in self.sequences for w in x[0]}
        self.shortest = min((len(x[0]) for x in self.sequences if x[2]), default=least)
        #: Of each state the whole phrases that its substrings, if long enough, end with; the templates that hold them.
        whole = {i: len(x[0]) for i, x in enumerate(self.sequences) if x[2]}
        self.phrases = [[] for _ in a.length]
        for i, n in whole.items():
            s = 0
            for w in self.sequences[i][0]:
                s = a.next[s][w]
            below = {s}
            for t in sorted(range(1, len(a.length)), key=lambda t: a.length[t]):
                if a.link[t] in below:
                    below.add(t)
            for t in below:
                self.phrases[t].append((n, i))
        self.places = [sorted((i, end) for i, end in ends if not self.sequences[i][2]) for ends in a.ends]

    def scan(self, text: bytes | None) -> dict:
        words = words_of(text)
        known = [i for i, w in enumerate(words) if w in self.words]
        base, matches, at = [], [], 0
        while at < len(known):  # stretches of words that occur in a template at all
            to = at + 1
            while to < len(known) and known[to] == known[to - 1] + 1:
                to += 1
            if to - at >= min(self.shortest, self.least):
                first = known[at]
                found = self.automaton.statistics(words[first : first + to - at])
                for k, (n, s) in enumerate(found):
                    base += [(first + k + 1 - size, i) for size, i in self.phrases[s] if n >= size]
                    if n >= self.least and (k + 1 == len(found) or found[k + 1][0] <= n):
                        matches.append((first + k + 1 - n, n, s))
            at = to
        places = [{"label": self.sequences[i][1], "start": start, "end": start + len(self.sequences[i][0])} for start, i in sorted(base)]
        return {"n_words": len(words), "base": places, "spans": self._chained(matches)}

    def _chained(self, matches: list[tuple[int, int, int]]) -> list[dict]:
        """Spans of which enough of a template's words stand, in order, in matches not too far apart; of overlapping spans the one with the most words."""
        by: dict[int, list[tuple[int, int, int, int]]] = {}  # of each template (start and end in text, end in template, words), by ends in text
        for start, n, s in matches:
            for i, end in self.places[s]:
                by.setdefault(i, []).append((start, start + n, end, n))
        good = []
        for i, rows in by.items():
            size = len(self.sequences[i][0])
            breaks = [k for k in range(1, len(rows)) if rows[k][0] > rows[k - 1][1] + self.gap]
            for a, b in zip([0, *breaks], [*breaks, len(rows)]):
                good += [(n, n / size, start, end, i) for n, start, end in self._best_chains(rows[a:b], size)]
        starts: list[int] = []
        taken: list[tuple] = []
        for x in sorted(good, key=lambda x: (-x[0], -x[1], x[3] - x[2], x[2], x[4])):
            at = bisect_right(starts, x[2])
            if (at == 0 or taken[at - 1][3] <= x[2]) and (at == len(taken) or taken[at][2] >= x[3]):
                starts.insert(at, x[2])
                taken.insert(at, x)
        return [{"label": self.sequences[i][1], "start": a, "end": b, "covered": min(1.0, c)} for _, c, a, b, i in taken]

    def _best_chains(self, rows: list[tuple[int, int, int, int]], size: int) -> list[tuple[int, int, int]]:
        """(words, start, end) of the best chain that ends with each match, if it holds enough of a template of `size` words.

        A match follows an earlier one that ends before it in text and template and at most the gap away; of overlapping words it counts the new ones.
        Whatever the chains, they hold no more words of the template than all matches together, and that is looked at first.
        """
        need, seen = self.covered * size, bytearray(size)
        for _, _, end, n in rows:
            seen[end - n : end] = b"\1" * n
        if sum(seen) < need:
            return []
        found, recent, at = [], [], 0  # recent: matches by end in text: (it, ends in template, best (words, -length, start) up to each, and of each)
        while at < len(rows):
            text_end, to = rows[at][1], at
            while to < len(rows) and rows[to][1] == text_end:
                to += 1
            recent = [g for g in recent if g[0] >= rows[at][0] - self.gap]
            own = []
            for start, _, end, n in sorted(rows[at:to], key=lambda r: r[2]):
                best = n, start
                for before, ends, most, each in recent:
                    new, k = min(n, text_end - before), bisect_right(ends, end - n)
                    if k:
                        best = max(best, (most[k - 1][0] + new, most[k - 1][1]))
                    for j in range(k, bisect_left(ends, end)):
                        best = max(best, (each[j][0] + min(new, end - ends[j]), each[j][1]))
                own.append((end, best))
            recent.append((text_end, [x[0] for x in own], list(accumulate((x[1] for x in own), max)), [x[1] for x in own]))
            if (top := max(x[1] for x in own))[0] >= need:
                found.append((top[0], top[1], text_end))
            at = to
        return found


_FOUND = "struct<n_words: bigint, base: array<struct<label: string, start: bigint, end: bigint>>, spans: array<struct<label: string, start: bigint, end: bigint, covered: double>>>"


def scan(text: Column, phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, least: int = 3, gap: int = 4, covered: float = 0.8) -> Column:
    """struct<n_words, base, spans> of a whole text: every place of a phrase, and the spans of templates; starts and ends are word positions.

    Words are runs of letters, digits and non-ASCII characters, A-Z in lower case. A text is streamed through the automaton: its matching statistics
    give phrases, where a whole one ends, and matches of at least `least` words, which are chained, at most `gap` words apart, into spans that hold
    the share `covered` of a template's words, in order; of all chains that with the most words. Overlapping spans: the one with the most words; ties go
    to the one that covers most of its template, then the shorter, the earlier, the first template given. Null and empty texts have no words, and empty
    arrays; equal texts equal results; no rows no rows. Texts of any length are read once, in time that grows with them. No other column is read. The
    automaton is made of the parameters alone; tasks make it once.
    """
    made: list[Scanner] = []
    place = [("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]
    kind = pa.struct([("n_words", pa.int64()), ("base", pa.list_(pa.struct(place))), ("spans", pa.list_(pa.struct([*place, ("covered", pa.float64())])))])

    @F.arrow_udf(_FOUND)
    def find(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Scanner(phrases, templates, least, gap, covered))
        return pa.array([made[0].scan(t.as_py()) for t in texts.cast(pa.binary())], kind)

    return find(text)


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases, statements, headers and whole licences of each document; see scan."""
    s = F.col("s")
    found = table(spark, sf_dir, "documents").select("doc_id", scan(F.col("text")).alias("s"))
    named = lambda *arrays: F.array_join(F.array_sort(F.array_distinct(F.concat(*[a["label"] for a in arrays]))), ",")
    starts = s["base"]["start"]
    score = F.when(F.size(s["base"]) > 0, 1.0).otherwise(F.coalesce(F.array_max(s["spans"]["covered"]), F.lit(0.0)))
    return found.select("doc_id", s["n_words"].alias("n_words"), F.size(s["base"]).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), named(s["base"]).alias("base_labels"), named(s["base"], s["spans"]).alias("labels"), score.alias("score"))


QUERIES = {"op9_licences": op9_licences}
ORACLE_SQL: dict[str, str] = {}
