"""Token ids of whole texts by a public tokenizer, from a cache of pieces.

The ids are those of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``
with the file as it is. ``tokenizers`` splits a text before it merges, and never merges
across those splits; so a text may be cut where a split is certain, each piece encoded
once by the library, and its ids kept. A text is cut twice:

* at blanks: byte-level vocabularies before a single blank between two signs that are
  not whitespace (the split rule always begins a new piece there), vocabularies that
  drop whitespace at every run of ASCII whitespace;
* pieces that are new are cut by the split rule itself into units, if all of their code
  points are of blocks whose classes all versions of Unicode agree on, and the units that
  are new are merged by the file's model. Other pieces are encoded whole by the library.

The pieces of a slice of texts are found, and their ids gathered, as Arrow columns: each
distinct piece of the slice is looked up once.

A text that holds the string of a special token is encoded whole by the library, and so
are all texts of a file whose normaliser or split rule is none of the two known here.

Defined results: a null or empty text has no ids; very long texts are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Pieces of one generation by default, and units of pieces for each; a Python worker keeps two generations (about 200 bytes an entry).
PIECES, UNITS_A_PIECE = 300_000, 2 / 3
_LONGEST = 64
_ID = attrgetter("id")
#: Whitespace other than one blank or line feed in front and single line feeds inside, between NUL signs: such pieces are not encoded with others.
_ODD = r"(?<!\0) |\n[\n\0]|(?<=\0 )\n"
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: For Arrow: texts in which a blank may not stand between two signs that are not whitespace; texts whose line feeds may not.
_NOT_PLAIN = r"\A | \z| [ \n\t\v\f\r\x1c-\x1f]|[\n\t\v\f\r\x1c-\x1f] |[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NO_LINES = r"\n\n|[\t\v\f\r\x1c-\x1f]"
#: Bytes of a text that is cut by itself, not with others as columns.
_TOGETHER = 64 << 20

# The split rule of byte-level vocabularies, and the parts of the file of those with word ends.
_BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_NORMAL = ["NFC", "Replace", "Lowercase"]

#: Latin, Greek without sigma (whose small form depends on its place), Cyrillic, kana, Han, Hangul: normalised and assigned for good.
_SETTLED = r"\xa1-˿Α-ΡΤ-ρτ-ωЀ-ҁҊ-ԯぁ-ゖァ-ヺ一-龥가-힣"
#: Signs that a byte-level vocabulary writes as themselves; the other bytes are written from U+0100 on, in order.
_AS_IS = [*range(33, 127), *range(161, 173), *range(174, 256)]
_WRITTEN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _AS_IS)}
_BAR = chr(_WRITTEN[10])


def resolve(vocabulary: str) -> str:
    """A path as it is; a bare name is looked up among the installed public vocabularies, on the machine that asks."""
    if os.sep in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


class Encoder:
    def __init__(self, vocabulary: str, pieces: int = PIECES):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = t = Tokenizer.from_file(resolve(vocabulary))
        normal = json.loads(t.normalizer.__getstate__()) if t.normalizer else None
        split = json.loads(t.pre_tokenizer.__getstate__()) if t.pre_tokenizer else {}
        steps = split.get("pretokenizers", [{}])
        self.leads = normal is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]
        words = normal is not None and [n["type"] for n in normal.get("normalizers", [])] == _WORD_NORMAL and steps[0].get("pattern") == {"Regex": _WORD_SPLIT} and steps[-1].get("type") == "ByteLevel" and len(steps) == 2
        added = t.get_added_tokens_decoder().values()
        # one that is looked for in normalised text can't be told from the text
        self.whole = not (self.leads or words) or any(a.normalized for a in added)
        self.specials = [a.content for a in added]
        self.most, self.most_units = pieces, int(UNITS_A_PIECE * pieces)
        # what has been met since the last generation began, and what the one before it met
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}
        self.older_units: dict[str, bytes] = {}
        if not self.whole:
            # a line feed between two pieces is a unit by itself
            self.find = regex.compile(_BYTE_SPLIT if self.leads else _WORD_SPLIT + r"|\n").findall
            self.settled = re.compile(("[\x01-\x7f" if self.leads else "[\x21-\x7e") + _SETTLED + "]+").fullmatch
            self.alone = re.compile((f"{_ODD}|[^\0\n\x20-\x7e" if self.leads else "[^\0\x21-\x7e") + _SETTLED + "]").finditer
            self.model = t.model
            #: id of a line feed, which is a unit by itself between pieces that are learnt together
            (self.bar,) = [x.id for x in self.model.tokenize(_BAR)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers. A null text has none."""
        ids, ends = self.flat(pa.array(texts, pa.string()))
        data, ends = ids.tobytes(), (4 * ends).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where those of each text end. A null text has none."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        apart = pc.binary_length(texts).to_numpy() > (-1 if self.whole else _TOGETHER)
        for s in self.specials:
            apart |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        odd = apart if not self.leads else apart | pc.match_substring_regex(texts, _NOT_PLAIN).to_numpy(zero_copy_only=False)
        words, counts = self._cut(texts.filter(pa.array(~odd)) if odd.any() else texts)
        coded = words.dictionary_encode()
        known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        # texts that are not cut as columns, with their pieces; one with a special token's string has none
        rest = {i: self.pieces(texts[i].as_py()) if not self.whole and not self._special(texts[i].as_py()) else None for i in np.flatnonzero(odd).tolist()}
        if len(self.kept) > self.most:
            self.kept, self.older = {}, self.kept
        found = list(map(self.kept.get, known))
        todo = [p for p, x in zip(known, found, strict=True) if x is None]
        if any(rest.values()):
            todo = list(set(todo).union(*filter(None, rest.values())).difference(self.kept))
        if todo:
            new = []
            for p, x in zip(todo, map(self.older.get, todo), strict=True):
                if x is None:
                    new.append(p)
                else:
                    self.kept[p] = x
            self._learn(new)
            found = [self.kept[p] if x is None else x for p, x in zip(known, found, strict=True)]
        taken = pa.array(found, pa.binary()).take(coded.indices)
        at = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1) if len(taken) else np.zeros(1, np.int32)
        ids = np.frombuffer(taken.buffers()[2] or b"", "<i4", at[-1] // 4)
        ends = at[np.cumsum(counts)].astype(np.int64) // 4
        if rest:
            parts, others = [], iter(np.split(ids, ends[:-1]) if len(ends) else ())
            for i in range(len(texts)):
                if i not in rest:
                    parts.append(next(others))
                elif rest[i] is None:
                    parts.append(np.frombuffer(self._ids(texts[i].as_py()), "<i4"))
                else:
                    parts.append(np.frombuffer(b"".join(map(self.kept.__getitem__, rest[i])), "<i4"))
            ids, ends = np.concatenate(parts), np.cumsum([len(x) for x in parts])
        for p in [p for p in todo if len(p) > _LONGEST]:
            del self.kept[p]
        return ids, ends

    def _special(self, text: str) -> bool:
        return any(s in text for s in self.specials)

    def pieces(self, text: str) -> list[str]:
        """A text in pieces, whatever its whitespace."""
        return _CUT.split(text) if self.leads else [x.decode() for x in text.encode().split()]

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts, which for byte-level vocabularies must not match ``_NOT_PLAIN``, and how many each has."""
        if not self.leads:
            lists = pc.ascii_split_whitespace(texts)
            return lists.flatten(), pc.list_value_length(lists).to_numpy()
        if not len(texts):
            return texts, np.zeros(0, np.int32)
        # pieces begin at blanks, and at line feeds between two signs that are not whitespace: all lie in the texts' own bytes
        at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8, at[-1] - at[0], int(at[0]))
        at = at - at[0]
        begins = (data == 32) | (data == 10)
        for i in np.flatnonzero(pc.match_substring_regex(texts, _NO_LINES).to_numpy(zero_copy_only=False)).tolist():
            begins[at[i] : at[i + 1]] = data[at[i] : at[i + 1]] == 32
        begins[at[:-1][np.diff(at) > 0]] = True
        begins = np.flatnonzero(begins).astype(np.int32)
        words = pa.StringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, at[-1]).astype(np.int32)), pa.py_buffer(data))
        return words, np.diff(np.searchsorted(begins, at))

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<i4").tobytes()

    def _learn(self, new: list[str]) -> None:
        leads, bulk = self.leads, new
        texts = bulk
        # pieces that aren't encoded with others are found in all of them at once
        joined = "\0".join(["", *texts, ""])
        apart = [m.start() for m in self.alone(joined)]
        if apart or joined.count("\0") != len(texts) + 1:
            if joined.count("\0") != len(texts) + 1:
                odd = [i for i, t in enumerate(texts) if "\0" in t or next(self.alone(f"\0{t}\0"), None)]
            else:
                odd = np.unique(np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), apart, side="right")).tolist()
            for i in odd:
                t = texts[i]
                self.kept[bulk[i]] = self._joined(self.find(t)) if leads and self.settled(t) else self._ids(t)
            gone = set(odd)
            bulk = [p for i, p in enumerate(bulk) if i not in gone]
            texts = [t for i, t in enumerate(texts) if i not in gone]
        if not bulk:
            return
        text = "\n".join([*texts, ""])
        data = self._joined(self.find(text if leads else text.lower()), np.array([self.bar], "<i4").tobytes())
        bars = np.flatnonzero(np.frombuffer(data, "<i4") == self.bar)
        # line feeds inside a piece are units too, and have the same id as those between pieces
        last = np.cumsum([t.count("\n") + 1 for t in texts]) if text.count("\n") > len(texts) else np.arange(1, len(texts) + 1)
        if len(bars) != last[-1]:
            raise AssertionError("a line feed was not a unit by itself")
        ends = 4 * bars[last - 1]
        self.kept.update(zip(bulk, [data[a:b] for a, b in zip([0, *(ends + 4).tolist()], ends.tolist())], strict=False))

    def _joined(self, units: list[str], line: bytes | None = None) -> bytes:
        """The ids of all units; ``line``: what stands for a line feed."""
        if len(self.units) > self.most_units:
            self.units, self.older_units = {}, self.units
        todo = set(units).difference(self.units)
        if line:
            todo.discard("\n")
        new = []
        for u, x in zip(todo, map(self.older_units.get, todo), strict=True):
            if x is None:
                new.append(u)
            else:
                self.units[u] = x
        self._merge(new)
        if line:
            self.units["\n"] = line
        out = b"".join(map(self.units.__getitem__, units))
        if line:
            del self.units["\n"]
        for u in new:
            if len(u) > _LONGEST:
                del self.units[u]
        return out

    def _merge(self, new: list[str]) -> None:
        lines = [u for u in new if "\n" in u]
        some = [u for u in new if "\n" not in u] if lines else new
        for u in lines:
            self.units[u] = self._ids(u)
        some.sort(key=str.isascii)
        for at in range(0, len(some), 1024):
            part = some[at : at + 1024]
            written = "\n".join(part)
            if written.isascii() and written.replace("\n", "").isprintable():
                written = written.replace(" ", chr(_WRITTEN[32])).split("\n")
            else:
                written = written.encode().decode("latin-1").translate(_WRITTEN).split(_BAR)
            # the model alone, without the library's record of where each sign of a text came from
            merged = list(map(self.model.tokenize, written))
            data = np.fromiter(map(_ID, chain.from_iterable(merged)), "<i4").tobytes()
            ends = (4 * np.cumsum(list(map(len, merged)))).tolist()
            self.units.update(zip(part, [data[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))


def ended(ids: np.ndarray, ends: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """As :meth:`Encoder.flat`, with the id ``end`` after each text."""
    return np.insert(ids, ends, end), ends + np.arange(1, len(ends) + 1)


@lru_cache(4)
def encoder(vocabulary: str, pieces: int = PIECES) -> Encoder:
    return Encoder(vocabulary, pieces)


#: Rows and bytes of text that are encoded together (a longer single text is encoded by itself).
ROWS, BYTES = 4096, 6 << 20


def spans(texts: pa.Array, most: int = BYTES) -> Iterator[tuple[int, int]]:
    """(first row, rows) of consecutive runs of texts of bounded size."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and (held + n > most or i - first == ROWS):
            yield first, i - first
            first, held = i, 0
        held += n
    if len(sizes):
        yield first, len(sizes) - first
