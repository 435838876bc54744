"""Licence scan: a generalised suffix automaton of licence tokens gives matching statistics of each text, and
long matches are chained into covered spans of licence templates.

A text's words (A-Z made lower, `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`) are hashed in one vector step and looked up
among the templates' words.  A match of two words or more can only lie where neighbouring words are neighbours
in some template, so the automaton is streamed over those runs alone; elsewhere its match is one word at most.

Defined results: a null or empty text has no words and no labels; repeated rows are scanned each by itself;
an empty table gives an empty result; columns besides doc_id and text are not read; texts are read whole.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WORD_BYTE, columns, run_hashes, slices, text_buffer, word_runs

#: Base phrases and their labels (fixed values).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Whole texts of short licences, the notices and grants of long ones, and official titles (fixed values: public
#: wording, as words in lower case).
MIT_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
MIT_TERMS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
BSD_TWO = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
BSD_THIRD = "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
BSD_TERMS = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
GNU_FREE = "is free software you can redistribute it and or modify it under the terms of the gnu"
GNU_NO_WARRANTY = "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu"
TEMPLATES = {
    "mit-text": f"{MIT_GRANT} {MIT_TERMS}",
    "bsd-2": f"{BSD_TWO} {BSD_TERMS}",
    "bsd-3": f"{BSD_TWO} {BSD_THIRD} {BSD_TERMS}",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution",
    "boost": "boost software license version 1 0 august 17th 2003 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and non infringement in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law",
    "apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "apache-2.0-grant": "grant of copyright license subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form grant of patent license subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license to make have made use offer to sell sell import and otherwise transfer the work",
    "gpl-2": f"this program {GNU_FREE} general public license as published by the free software foundation either version 2 of the license or at your option any later version this program {GNU_NO_WARRANTY} general public license for more details you should have received a copy of the gnu general public license along with this program if not write to the free software foundation inc 51 franklin street fifth floor boston ma 02110 1301 usa",
    "gpl-3": f"this program {GNU_FREE} general public license as published by the free software foundation either version 3 of the license or at your option any later version this program {GNU_NO_WARRANTY} general public license for more details you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses",
    "lgpl": f"this library {GNU_FREE} lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version this library {GNU_NO_WARRANTY} lesser general public license for more details you should have received a copy of the gnu lesser general public license along with this library",
    "agpl-3": f"this program {GNU_FREE} affero general public license as published by the free software foundation either version 3 of the license or at your option any later version this program {GNU_NO_WARRANTY} affero general public license for more details you should have received a copy of the gnu affero general public license along with this program if not see https www gnu org licenses",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
}
#: Official titles and short names; one of them whole is a place of its own, whatever stands around it.
TITLES = {
    "apache license version 2 0": "apache-2.0", "apache license 2 0": "apache-2.0", "gnu general public license version 2": "gpl-2", "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl-3", "mozilla public license version 2 0": "mpl-2.0", "mozilla public license 2 0": "mpl-2.0",
    "bsd 2 clause": "bsd-2", "bsd 3 clause": "bsd-3", "isc license": "isc", "zlib license": "zlib", "boost software license": "boost", "cc0 1 0": "cc0", "creative commons zero": "cc0",
    "cc by 4 0": "cc-by", "cc by sa 4 0": "cc-by-sa", "cc by nc 4 0": "cc-by-nc", "cc by nd 4 0": "cc-by-nd", "cc by nc sa 4 0": "cc-by-nc-sa", "cc by nc nd 4 0": "cc-by-nc-nd",
    "creative commons attribution 4 0": "cc-by", "creative commons attribution sharealike 4 0": "cc-by-sa", "creative commons attribution noncommercial 4 0": "cc-by-nc",
}


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of token numbers.

    Each state stands for the token strings that end at the same places of the sequences; `longest` is the
    longest of them and `link` leads to the state of the next shorter group.  `where[state]` is one place
    (sequence, end) of it, `within[state]` the sequences in which its strings occur.
    """

    def __init__(self, sequences: list[list[int]]):
        self.go: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        self.within: list[set[int]] = [set()]
        self.heads: list[list[int]] = []
        for k, seq in enumerate(sequences):
            at, heads = 0, []
            for token in seq:
                at = self._add(at, token)
                heads.append(at)
            self.heads.append(heads)
        for k, heads in enumerate(self.heads):
            for state in heads:
                while state > 0 and k not in self.within[state]:
                    self.within[state].add(k)
                    state = self.link[state]

    def _new(self, longest: int) -> int:
        self.go.append({})
        self.link.append(0)
        self.longest.append(longest)
        self.within.append(set())
        return len(self.go) - 1

    def _split(self, at: int, token: int, state: int) -> int:
        """A state for the strings of `state` no longer than those of `at` and the token."""
        part = self._new(self.longest[at] + 1)
        self.go[part] = dict(self.go[state])
        self.link[part], self.link[state] = self.link[state], part
        while at >= 0 and self.go[at].get(token) == state:
            self.go[at][token] = part
            at = self.link[at]
        return part

    def _add(self, at: int, token: int) -> int:
        if token in self.go[at]:  # the prefix occurs in an earlier sequence
            state = self.go[at][token]
            return state if self.longest[state] == self.longest[at] + 1 else self._split(at, token, state)
        new, p = self._new(self.longest[at] + 1), at
        while p >= 0 and token not in self.go[p]:
            self.go[p][token] = new
            p = self.link[p]
        if p >= 0:
            state = self.go[p][token]
            self.link[new] = state if self.longest[state] == self.longest[p] + 1 else self._split(p, token, state)
        return new

    def step(self, state: int, size: int, token: int) -> tuple[int, int]:
        """The state and length of the longest suffix of what was read that occurs in a sequence."""
        while state and token not in self.go[state]:
            state = self.link[state]
            size = self.longest[state]
        if token in self.go[state]:
            return self.go[state][token], size + 1
        return 0, 0


class LicenseIndex:
    """The automaton of all templates and phrases, with the lookups that streaming needs."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str], titles: dict[str, str] = {}, least: int = 4, gap: int = 6, words: int = 8):  # noqa: B006
        self.least, self.gap, self.words = least, gap, words
        texts = [*phrases, *titles, *templates.values()]
        self.labels, self.n_base, self.n_phrases = [*phrases.values(), *titles.values(), *templates], len(phrases), len(phrases) + len(titles)
        names = sorted({w for t in texts for w in t.split()})
        self.number = {w: i for i, w in enumerate(names)}
        self.sequences = [[self.number[w] for w in t.split()] for t in texts]
        self.auto = SuffixAutomaton(self.sequences)
        raw = np.frombuffer("".join(names).encode(), np.uint8)
        size = np.array([len(w.encode()) for w in names])
        ends = np.cumsum(size)
        hashes = run_hashes(raw, ends - size, ends)
        order = np.argsort(hashes)
        self.hashes, self.numbers, self.names = hashes[order], order, [w.encode() for w in names]
        n = len(names)
        self.pair = np.zeros((n, n), dtype=bool)
        for s in self.sequences:
            self.pair[s[:-1], s[1:]] = True
        #: phrases that end in a state, with the length that the match needs
        ends_in = [[] for _ in self.auto.go]
        for k in range(self.n_phrases):
            ends_in[self.auto.heads[k][-1]].append((k, len(self.sequences[k])))
        self.ends = []
        for state in range(len(ends_in)):
            found, at = [], state
            while at > 0:
                found += ends_in[at]
                at = self.auto.link[at]
            self.ends.append(found)

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each word's number, or -1."""
        h = run_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.numbers[at], -1)

    def read(self, tokens: list[int]):
        """Streams a run through the automaton: (end, length, state) at each token."""
        state = size = 0
        for i, t in enumerate(tokens):
            state, size = self.auto.step(state, size, t)
            yield i + 1, size, state

    def matches(self, tokens: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Phrase places (phrase, begin) and long maximal matches (begin, end, state) of a run."""
        places, found, before = [], [], (0, 0, 0)
        for end, size, state in self.read(tokens):
            places += [(k, end - need) for k, need in self.ends[state] if need <= size]
            if size <= before[1] and before[1] >= self.least:
                found.append((before[0] - before[1], before[0], before[2]))
            before = (end, size, state)
        if before[1] >= self.least:
            found.append((before[0] - before[1], before[0], before[2]))
        return places, found

    def chain(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float, int]]:
        """(template, begin, end, covered share, matched words) of the long matches' chains: per template, matches
        that follow each other within `gap` words are one chain.  Of chains over the same words that of the most
        matched words stays, so a wording that licences share counts for the one that it goes on as."""
        open_, spans = {}, []
        for a, b, state in found:
            for k in self.auto.within[state]:
                if k < self.n_phrases:
                    continue
                c = open_.get(k)
                if c and a - c[1] <= self.gap:
                    c[2] += b - max(a, c[1])
                    c[1] = max(b, c[1])
                else:
                    if c:
                        spans.append((k, *c))
                    open_[k] = [a, b, b - a]
        spans += [(k, *c) for k, c in open_.items()]
        spans.sort(key=lambda c: (-c[3], c[1], c[0]))
        best = np.zeros(0, np.int64)  # most matched words of a chain over each word
        if spans:
            first, last = min(c[1] for c in spans), max(c[2] for c in spans)
            best = np.zeros(last - first, np.int64)
        out = []
        for k, a, b, n in spans:
            under = best[a - first : b - first]
            if n >= self.words and 2 * (under > n).sum() < b - a:
                out.append((k, a, b, min(1.0, n / len(self.sequences[k])), n))
            np.maximum(under, n, out=under)
        return out


@cache
def default_index() -> LicenseIndex:
    return LicenseIndex(PHRASES, TEMPLATES, TITLES)


_PLACE = "struct<label:string,start:bigint,end:bigint,covered:double,words:bigint,base:boolean>"

#: A span of this share of its template, or of so many of its words, gives the text the template's label.
COVER, PASSAGE = 0.5, 30


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, and `places`: word spans of base phrases, of titles, and of chained template matches with the
    matched words and the share of the template that they cover, however small.  One pass over the texts; nothing is shuffled."""
    place = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64()), ("words", pa.int64()), ("base", pa.bool_())])

    def run(batches):
        index = default_index()
        for whole in batches:
            for batch in slices(whole):
                raw, at = text_buffer(batch.column("text"))
                data = LOWER[raw]
                starts, ends, n_words = word_runs(data, at, WORD_BYTE)
                ids = index.ids(data, starts, ends)
                first = np.cumsum(n_words) - n_words
                ok = (ids[:-1] >= 0) & (ids[1:] >= 0)
                ok[ok] = index.pair[ids[:-1][ok], ids[1:][ok]]
                inner = first[(first > 0) & (first < len(ids))]
                ok[inner - 1] = False  # words of different texts aren't neighbours
                edge = np.flatnonzero(np.diff(np.concatenate([[False], ok, [False]]).astype(np.int8)))
                found: dict[int, tuple[list, list]] = {}
                docs_of = np.searchsorted(first, edge[::2], side="right") - 1
                for a, b, doc in zip(edge[::2].tolist(), (edge[1::2] + 1).tolist(), docs_of.tolist()):
                    tokens = ids[a:b].tolist()
                    if any(data[starts[a + i] : ends[a + i]].tobytes() != index.names[t] for i, t in enumerate(tokens)):
                        continue
                    places, long = index.matches(tokens)
                    if places or long:
                        had = found.setdefault(doc, ([], []))
                        base = a - int(first[doc])
                        had[0].extend((k, base + p) for k, p in places)
                        had[1].extend((base + x, base + y, s) for x, y, s in long)
                rows = [[] for _ in range(batch.num_rows)]
                for doc, (places, long) in found.items():
                    sized = [(k, p, len(index.sequences[k])) for k, p in places]
                    rows[doc] = [{"label": index.labels[k], "start": p, "end": p + n, "covered": 1.0, "words": n, "base": k < index.n_base} for k, p, n in sized]
                    rows[doc] += [{"label": index.labels[k], "start": a, "end": b, "covered": c, "words": n, "base": False} for k, a, b, c, n in index.chain(long)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(rows, pa.list_(place))], ["doc_id", "n_words", "places"])

    return columns(docs, doc_id="bigint", text="string").mapInArrow(run, f"doc_id bigint, n_words bigint, places array<{_PLACE}>")


def license_digest(docs: DataFrame) -> DataFrame:
    """The scan as one row of counts and labels per document.  Spans short of a label still count for the score."""
    base = F.filter("places", lambda p: p["base"])
    sure = F.filter("places", lambda p: (p["covered"] >= COVER) | (p["words"] >= PASSAGE))
    starts = F.transform(base, lambda p: p["start"])
    named = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: p["label"]))), ",")
    strength = lambda p: F.greatest(p["covered"], F.least(F.lit(1.0), p["words"] / F.lit(float(PASSAGE))))
    return scan_licenses(docs).select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        named(base).alias("base_labels"), named(sure).alias("labels"), F.coalesce(F.array_max(F.transform("places", strength)), F.lit(0.0)).alias("score"),
    )
