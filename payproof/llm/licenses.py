"""License scans: phrases, and license notices matched against templates with optional and replaceable regions.

A template is running text in which `[ ... ]` is optional, `{n}` stands for at most n words of any kind and `(a|b)` for one
of some words. It is compiled into a finite automaton over words. A text is accepted where the automaton reaches its end:
all the mandatory wording is there, in order, and between its words nothing else but what the markup allows. The templates of
licenses have their whole wording to the end of the disclaimer; notices and openings have labels of their own.

A null text counts as an empty one, without words and labels. Rows are judged one by one; other columns are not looked at.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from payproof.llm import words as W

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_MIT_DISCLAIMER = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties "
    "of merchantability fitness for a particular purpose and noninfringement in no event shall the authors [or copyright holders] "
    "be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or "
    "in connection with the software or the use or other dealings in the software"
)
_MIT_OPENING = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the rights "
    "to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom "
    "the software is furnished to do so subject to the following conditions"
)
_ISC_OPENING = (
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
    "provided that the above copyright notice and this permission notice appear in all copies"
)
_BSD_OPENING = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met [1] redistributions of source code must retain the above copyright notice this list of "
    "conditions and the following disclaimer"
)
_BSD_BINARY = (
    "[2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
    "disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_DISCLAIMER = (
    "this software is provided by {12} as is and any express or implied warranties including but not limited to the implied "
    "warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {12} be liable for any "
    "direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute "
    "goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether "
    "in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software "
    "even if advised of the possibility of such damage"
)
_ZLIB_OPENING = (
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable "
    "for any damages arising from the use of this software"
)

#: Wording of public licenses (fixed values), whole from the first mandatory word to the last.
LICENSES = {
    "mit": f"{_MIT_OPENING} the above copyright notice and this permission notice [including the next paragraph] shall be included in "
    f"all copies or substantial portions of the software {_MIT_DISCLAIMER}",
    "isc": f"{_ISC_OPENING} the software is provided as is and the author disclaims all warranties with regard to this software "
    "including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct "
    "indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of "
    "contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd-2-clause": f"{_BSD_OPENING} {_BSD_BINARY} {_BSD_DISCLAIMER}",
    "bsd-3-clause": f"{_BSD_OPENING} {_BSD_BINARY} [3] neither the name of {{10}} nor the names of {{4}} contributors may be used to "
    f"endorse or promote products derived from this software without specific prior written permission {_BSD_DISCLAIMER}",
    "zlib": f"{_ZLIB_OPENING} permission is granted to anyone to use this software for any purpose including commercial applications and "
    "to alter it and redistribute it freely subject to the following restrictions [1] the origin of this software must not be "
    "misrepresented you must not claim that you wrote the original software if you use this software in a product an "
    "(acknowledgment|acknowledgement) in the product documentation would be appreciated but is not required [2] altered source versions "
    "must be plainly marked as such and must not be misrepresented as being the original software [3] this notice may not be removed "
    "or altered from any source distribution",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use "
    "compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non "
    "commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and "
    "all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to "
    "the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all "
    f"present and future rights to this software under copyright law {_MIT_DISCLAIMER}",
}
#: Wording of usual notices, and how licenses begin (fixed values): what they say a text is under, not the license itself.
NOTICES = {
    "mit-notice": "released under the [terms of the] mit license",
    "mit-notice-licensed": "licensed under the mit license",
    "apache-2.0-notice": "licensed under the apache license version 2 0 [the license you may not use this file except in compliance "
    "with the license you may obtain a copy of the license at {8}]",
    "gpl-3.0-notice": "licensed under the gnu general public license version 3 [or (later|newer)] [0] [only]",
    "gpl-2.0-notice": "licensed under the gnu general public license version 2 [or (later|newer)] [0] [only]",
    "gpl-or-later-notice": "you can redistribute it and or modify it under the terms of the gnu [(lesser|affero)] general public license as "
    "published by the free software foundation either version {2} of the license or at your option any later version",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-notice": "licensed under a creative commons attribution [(noncommercial|sharealike|noderivatives)] {2} [international] license",
    "mit-opening": _MIT_OPENING,
    "isc-opening": _ISC_OPENING,
    "bsd-opening": _BSD_OPENING,
    "zlib-opening": _ZLIB_OPENING,
    "unlicense-opening": "this is free and unencumbered software released into the public domain",
}
TEMPLATES = LICENSES | NOTICES
ANCHOR = 3

ANY = None


class Automaton:
    """Words of a template as states; each state lists the moves out of it, after those without a word are followed."""

    def __init__(self, template: str):
        self.free: list[list[int]] = [[]]
        self.moves: list[list[tuple[str | None, int]]] = [[]]
        tokens = re.findall(r"\[|\]|\{\d+\}|\([^)]*\)|[^\s\[\]{}()]+", template)
        self.anchor = tuple(tokens[:ANCHOR])
        if len(self.anchor) < ANCHOR or any(re.search(r"[\[\]{}()|]", t) for t in self.anchor):
            raise ValueError(f"a template begins with {ANCHOR} mandatory words: {template[:60]!r}")
        self.end = self._sequence(tokens, 0)
        self.closure = [self._reach(s) for s in range(len(self.free))]

    def _state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def _step(self, state: int, choices: list[str | None]) -> int:
        new = self._state()
        self.moves[state] += [(c, new) for c in choices]
        return new

    def _sequence(self, tokens: list[str], state: int) -> int:
        optional: list[int] = []
        for token in tokens:
            if token == "[":
                optional.append(state)
                state = self._state()
                self.free[optional[-1]].append(state)
            elif token == "]":
                self.free[optional.pop()].append(after := self._state())
                self.free[state].append(after)
                state = after
            elif token[0] == "{":
                for _ in range(int(token[1:-1])):
                    new = self._step(state, [ANY])
                    self.free[state].append(new)
                    state = new
            else:
                state = self._step(state, list(token.strip("()").split("|")))
        if optional:
            raise ValueError("an optional region is not closed")
        return state

    def _reach(self, state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def accepts(self, word: Callable[[int], str | None]) -> bool:
        """Whether a run of words from word(0) on takes the automaton to its end; word gives None after the last."""
        states, i = self.closure[0], 0
        while states:
            if self.end in states:
                return True
            if (w := word(i)) is None:
                return False
            states = frozenset().union(*(self.closure[to] for s in states for on, to in self.moves[s] if on is ANY or on == w))
            i += 1
        return False


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return W.words(W.Chunk(0, data, np.array([0, len(data)])), W.LETTERS, lower=True).hashes


class Scanner:
    """Finds phrases and accepted templates in chunks of texts."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.phrases = [(_hashes(phrase), label) for phrase, label in phrases.items()]
        self.by_anchor: dict[int, list[tuple[str, Automaton]]] = {}
        for label, template in templates.items():
            automaton = Automaton(template)
            key = int(W.window_hashes(_hashes(" ".join(automaton.anchor)), ANCHOR)[0])
            self.by_anchor.setdefault(key, []).append((label, automaton))
        self.anchors = np.array(sorted(self.by_anchor), np.uint64)
        self.likely = np.zeros(1 << 16, bool)
        self.likely[self.anchors.astype(np.int64) & 0xFFFF] = True

    def _accepted(self, chunk: W.Chunk, found: W.Words) -> list[set[str]]:
        out: list[set[str]] = [set() for _ in range(chunk.n)]
        keys = W.window_hashes(found.hashes, ANCHOR)
        at = np.flatnonzero(self.likely[(keys & np.uint64(0xFFFF)).astype(np.int64)])
        at = at[np.isin(keys[at], self.anchors)]
        for i, text in zip(at.tolist(), (np.searchsorted(found.by_text, at, side="right") - 1).tolist(), strict=True):
            stop = found.by_text[text + 1]

            def word(k: int, i: int = i, stop: int = stop) -> str | None:
                if i + k >= stop:
                    return None
                part = chunk.data[found.starts[i + k] : found.ends[i + k]]
                return W.LOWER[part].tobytes().decode("utf-8", "replace")

            out[text] |= {
                label
                for label, automaton in self.by_anchor[int(keys[i])]
                if label not in out[text] and automaton.accepts(word)
            }
        return out

    def __call__(self, texts: pa.Array) -> pa.Array:
        parts = []
        for chunk in W.chunks(texts):
            found = W.words(chunk, W.LETTERS, lower=True)
            starts, labels = [], [set() for _ in range(chunk.n)]
            for phrase, label in self.phrases:
                hit = W.whole_windows(found, len(phrase))
                for k, h in enumerate(phrase):
                    hit[: len(hit) - k] &= found.hashes[k:] == h
                at = np.flatnonzero(hit)
                starts.append(at)
                for text in np.unique(found.text_of[at]).tolist() if len(at) else ():
                    labels[text].add(label)
            at = np.sort(np.concatenate(starts))
            text = np.searchsorted(found.by_text, at, side="right") - 1
            n_base = np.bincount(text, minlength=chunk.n)
            bound = np.cumsum(n_base)
            place = at - found.by_text[text]
            none = n_base == 0
            first, last = np.zeros(chunk.n, np.int64), np.zeros(chunk.n, np.int64)
            first[~none], last[~none] = place[(bound - n_base)[~none]], place[bound[~none] - 1]
            accepted = self._accepted(chunk, found)
            parts.append(
                pa.StructArray.from_arrays(
                    [
                        pa.array(found.counts, pa.int64()),
                        pa.array(n_base, pa.int64()),
                        pa.array(first, pa.int64(), mask=none),
                        pa.array(last, pa.int64(), mask=none),
                        pa.array([",".join(sorted(x)) for x in labels], pa.string()),
                        pa.array([",".join(sorted(x | y)) for x, y in zip(labels, accepted, strict=True)], pa.string()),
                        pa.array([self.score(x, y) for x, y in zip(labels, accepted, strict=True)], pa.float64()),
                    ],
                    names=[f.strip().split(": ")[0] for f in FOUND[7:-1].split(",")],
                )
            )
        return pa.concat_arrays(parts) if parts else pa.array([], _type())

    def score(self, phrases: set[str], accepted: set[str]) -> float:
        """1 for the whole wording of a license, 0.75 for a notice or an opening, 0.5 for a phrase alone."""
        return 1.0 if accepted & LICENSES.keys() else 0.75 if accepted else 0.5 if phrases else 0.0


FOUND = (
    "struct<n_words: bigint, n_base: bigint, first_word: bigint, last_word: bigint, "
    "base_labels: string, labels: string, score: double>"
)


def _type() -> pa.DataType:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}
    return pa.struct([(name, kinds[kind]) for name, kind in (f.strip().split(": ") for f in FOUND[7:-1].split(","))])


@functools.cache
def _scanner() -> Scanner:
    return Scanner(PHRASES, TEMPLATES)


@functools.cache
def _scan_udf():
    @arrow_udf(FOUND)
    def scan(texts: pa.Array) -> pa.Array:
        return _scanner()(texts)

    return scan.asNondeterministic()


def scanned(docs: DataFrame, text: str = "text", into: str = "license") -> DataFrame:
    """Every row as it is, with what its text holds, as column ``into``, which replaces one of that name."""
    return docs.withColumn(into, _scan_udf()(F.col(text).cast("string")))
