"""Licence scan: templates with optional and replaceable regions, compiled to token automata.

A template is the licence's wording in which ``[[ ... ]]`` encloses an optional region
and ``{{n}}`` stands for a replaceable region of up to n words. Its words become the
states of an automaton whose state set is one integer: a text is accepted where the
mandatory wording stands exactly, in order, with nothing between but what the regions
allow. The automaton starts only where the template's first mandatory words stand.

Words are runs of bytes other than ASCII signs and blanks, after A-Z is lower-cased.

Defined results: a null text is empty: no words, no labels, score 0; very long texts
are read whole, in linear time; repeated rows are judged each on its own; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workers import alone

#: phrase -> label; reported wherever the words stand consecutively.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_WARRANTY_BSD = """this software is provided by {{12}} as is and any express or implied warranties including but not
limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall
{{12}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to
procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any
theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out
of the use of this software even if advised of the possibility of such damage"""
_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the
following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of
conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this
list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"""

TEMPLATES = {
    "mit": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the rights
        to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to
        whom the software is furnished to do so subject to the following conditions the above copyright notice and this
        permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the
        software the software is provided as is without warranty of any kind express or implied including but not limited to
        the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {{6}} be
        liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out
        of or in connection with the software or the use or other dealings in the software""",
    "isc": """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby
        granted [[provided that the above copyright notice and this permission notice appear in all copies]] the software is
        provided as is and {{8}} disclaims all warranties with regard to this software including all implied warranties of
        merchantability and fitness in no event shall {{8}} be liable for any special direct indirect or consequential
        damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract
        negligence or other tortious action arising out of or in connection with the use or performance of this software""",
    "bsd-2-clause": f"{_BSD} {_WARRANTY_BSD}",
    "bsd-3-clause": f"""{_BSD} [[3]] neither the name of {{{{12}}}} nor the names of its contributors may be used to endorse
        or promote products derived from this software without specific prior written permission {_WARRANTY_BSD}""",
    "apache-2": """licensed under the apache license version 2 0 the license you may not use this file except in compliance
        with the license you may obtain a copy of the license at [[http www apache org licenses license 2 0]]""",
    "unlicense": """this is free and unencumbered software released into the public domain anyone is free to copy modify
        publish use compile sell or distribute this software either in source code form or as a compiled binary for any
        purpose commercial or non commercial and by any means""",
    "zlib": """this software is provided as is without any express or implied warranty in no event will {{8}} be held liable
        for any damages arising from the use of this software permission is granted to anyone to use this software for any
        purpose including commercial applications and to alter it and redistribute it freely subject to the following
        restrictions""",
}

_LOWER_AND_BLANK = bytes(32 if c < 0x30 or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
#: Words that must match before the automaton starts.
ANCHOR = 4


class Automaton:
    """States 0..n: words read so far. ``step`` advances a set of states, held as the bits of one integer, by one word."""

    def __init__(self, template: str):
        self.n = 0
        self.masks: dict[bytes, int] = {}
        self.skips: list[tuple[int, int]] = []  # free moves (from, to), in order
        any_, open_, self.mandatory = 0, None, []
        for token in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\[\]{}\s]+", template):
            if token == "[[":
                open_ = self.n
            elif token == "]]":
                self.skips.append((open_, self.n))
                open_ = None
            elif token.startswith("{{"):
                for _ in range(int(token[2:-2])):
                    any_ |= 1 << self.n
                    self.n += 1
                    self.skips.append((self.n - 1, self.n))
            else:
                word = token.encode()
                self.masks[word] = self.masks.get(word, 0) | 1 << self.n
                self.n += 1
                if open_ is None:
                    self.mandatory.append(word)
        self.any = any_
        self.skips.sort()
        self.anchor = b" ".join(self.mandatory[:ANCHOR])
        self.accept = 1 << self.n

    def closed(self, states: int) -> int:
        for a, b in self.skips:
            if states >> a & 1:
                states |= 1 << b
        return states

    def step(self, states: int, word: bytes) -> int:
        states = (states & (self.masks.get(word, 0) | self.any)) << 1
        return self.closed(states) if states else 0

    def match(self, words: list[bytes], start: int) -> tuple[int, int]:
        """(end of the longest acceptance from ``start``, or -1; farthest state reached)."""
        states, end, far = self.closed(1), -1, 0
        for i in range(start, len(words)):
            states = self.step(states, words[i])
            if not states:
                break
            far = max(far, states.bit_length() - 1)
            if states & self.accept:
                end = i + 1
        return end, far


@lru_cache(None)
def automata() -> dict[str, Automaton]:
    return {label: Automaton(t) for label, t in TEMPLATES.items()}


def normal(text: bytes | None) -> bytes:
    """The words of a text, each with a blank before and one more at the end."""
    return b" " + b"".join(w + b" " for w in (text or b"").translate(_LOWER_AND_BLANK).split(b" ") if w)


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Index of the first word of each place where ``phrase`` (words joined by blanks) stands."""
    out, at, word, seen = [], 0, 0, 0
    needle = b" " + phrase + b" "
    while (at := joined.find(needle, at)) >= 0:
        word += joined.count(b" ", seen, at)
        seen = at
        out.append(word)
        at += 1
    return out


def scan_text(text: bytes | None) -> dict:
    joined = normal(text)
    n = joined.count(b" ") - 1
    starts, base = [], set()
    for phrase, label in PHRASES.items():
        if found := places(joined, phrase.encode()):
            starts += found
            base.add(label)
    labels, score, words = set(base), 1.0 if base else 0.0, None
    for label, a in automata().items():
        for start in places(joined, a.anchor) if a.anchor in joined else []:
            words = joined.split() if words is None else words
            end, far = a.match(words, start)
            if end >= 0:
                labels.add(label)
            score = max(score, 1.0 if end >= 0 else 0.9 * far / a.n)
    return {"n_words": n, "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": score}


_OUT = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]


@alone("licenses")
def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [scan_text(x.as_py()) for x in batch.column("_text").cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), *(pa.array([r[k] for r in rows], t) for k, t in _OUT)], ["doc_id", *(k for k, _ in _OUT)])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    score: 1 if a phrase or a whole template matched, else 0.9 times the matched share of the best template begun.
    """
    kind = docs.select(F.col(id_col).alias("i")).dtypes[0][1]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(_scan, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
