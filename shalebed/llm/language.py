"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's
probability is the sum, over all ways to cut it into pieces, of the product of their
probabilities (forward algorithm); a text's is the product over its words. The
probabilities are learned by expectation-maximisation from labelled texts, on counts of
distinct words by language.

A word is a run of lower-cased code points other than ASCII signs, digits and
whitespace, with the vocabulary's word-start mark in front; code points without a piece count
as a piece of small fixed probability. Words of any length are summed over all their
segmentations, with rescaled probabilities; only for learning are words over ``LEARNT``
code points cut.

Defined results: ``und`` with score 0 for a null text, a text without a letter, or if
there is no labelled text; ties go to the language whose name sorts first; very long
texts and words are scored whole, in bounded memory; repeated rows are scored each; an
empty table gives no rows; a column of the documents that has the name of a result
(``lang_pred``, ``score``) gives way to it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import stage
from .tokens import resolve
from .workers import alone, caching

VOCABULARY = "piece_bpe_32k.model"
ROUNDS = 2
#: Longest part of a word that is learned from as one.
LEARNT = 256
#: Steps after which probabilities are rescaled.
SCALED = 16
#: Code points of words that are scored together; longer ones by themselves, so many at a time.
TOGETHER = 1 << 16
#: Words and tokens between blanks, and numbers in their scores, that one Python worker keeps.
CACHE, CELLS = 300_000, 4_000_000
#: Characters of text whose words are looked up together (a longer single text is looked up whole).
SLICE = 1 << 20
UNSEEN = 1e-7
_SMOOTH = 0.05
_RUNS = re.compile(r"[^\x00-\x60\x7b-\x7f]+").findall


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@lru_cache(2)
def pieces(vocabulary: str) -> tuple[dict[str, int], int]:
    """Index of each ordinary piece, lower-cased; the longest one's length."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=resolve(vocabulary))
    out: dict[str, int] = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            out.setdefault(model.id_to_piece(i).lower(), len(out))
    return out, max(map(len, out))


@lru_cache(2)
def automaton(vocabulary: str) -> ahocorasick.Automaton:
    """Finds every piece in a text; a match's value is its index and, in the low eight bits, its length."""
    out = ahocorasick.Automaton()
    for x, i in pieces(vocabulary)[0].items():
        if "\n" not in x:
            out.add_word(x, i << 8 | len(x))
    out.make_automaton()
    return out


def parts(word: str) -> list[str]:
    """A word, with the mark in front, as it is learned from."""
    word = "▁" + word
    return [word] if len(word) <= LEARNT else [word[i : i + LEARNT] for i in range(0, len(word), LEARNT)]


def arcs(part: str, known: dict[str, int], longest: int) -> list[list[tuple[int, int]]]:
    """For each end, (start, piece) of the pieces that end there; -1 for a code point without one."""
    out = []
    for end in range(1, len(part) + 1):
        here = [(a, known[x]) for a in range(max(0, end - longest), end) if (x := part[a:end]) in known]
        if not here or here[-1][0] != end - 1:
            here.append((end - 1, -1))
        out.append(here)
    return out


@dataclass
class Model:
    vocabulary: str
    langs: list[str]
    #: pieces + 1 (unseen, last) rows, a column for each language
    probs: np.ndarray
    #: row of ``rows`` that holds the score of a word, and of a token between blanks
    words: dict[str, int] = field(default_factory=dict, repr=False)
    tokens: dict[str, int] = field(default_factory=dict, repr=False)
    rows: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {"vocabulary": self.vocabulary, "langs": self.langs, "probs": self.probs, "words": {}, "tokens": {}, "rows": []}

    def forget(self) -> None:
        self.words, self.tokens, self.rows = {}, {}, []

    def logs(self, words: list[str]) -> np.ndarray:
        """log of each word's probability in each language."""
        out = np.zeros((len(words), len(self.langs)))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        held, cells = [], 0
        for i in order:
            if len(words[i]) >= TOGETHER:
                out[i] = self._long("▁" + words[i])
                continue
            # all words of a group are padded to its longest one
            if held and (len(words[i]) + 1) * (len(held) + 1) > TOGETHER:
                out[held] = self._forward(["▁" + words[k] for k in held])
                held = []
            held.append(i)
        if held:
            out[held] = self._forward(["▁" + words[k] for k in held])
        return out

    def _arcs(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end, length, piece) of all pieces in a text whose line feeds stand between words; -1 for a code point that is none."""
        found = np.fromiter(chain.from_iterable(automaton(self.vocabulary).iter(text)), np.int64).reshape(-1, 2)
        end, length, piece = found[:, 0] + 1, found[:, 1] & 0xFF, found[:, 1] >> 8
        alone = np.ones(len(text) + 1, bool)
        alone[end[length == 1]] = False
        alone[0] = False
        unseen = np.flatnonzero(alone)
        return np.concatenate([end, unseen]), np.concatenate([length, np.ones_like(unseen)]), np.concatenate([piece, np.full_like(unseen, -1)])

    def _forward(self, words: list[str]) -> np.ndarray:
        """The forward algorithm over many words at once: step e adds, for every word, the arcs that end at its place e."""
        size = np.array([len(x) for x in words], np.int64)
        begin = np.cumsum(size + 1) - size - 1
        end, length, piece = self._arcs("\n".join(words))
        at = np.searchsorted(begin, end - 1, side="right") - 1
        step = end - begin[at]
        order = np.lexsort((at, step))
        order = order[step[order] <= size[at[order]]]  # line feeds are a step beyond their word
        at, step, length, piece = at[order], step[order], length[order], piece[order]
        probs, longest = self.probs.astype(np.float64), pieces(self.vocabulary)[1]
        alpha = np.zeros((int(size.max()) + 1, len(words), len(self.langs)))
        alpha[0] = 1.0
        last, logs = alpha[0].copy(), np.zeros_like(alpha[0])
        cut = np.searchsorted(step, np.arange(1, len(alpha) + 1))
        for e in range(1, len(alpha)):
            here = slice(cut[e - 1], cut[e])
            x = alpha[e - length[here], at[here]] * probs[piece[here]]
            first = np.flatnonzero(np.diff(at[here], prepend=-1))
            last[at[here][first]] = alpha[e, at[here][first]] = np.add.reduceat(x, first)
            if e % SCALED == 0 and e + 1 < len(alpha):
                going = size > e
                scale = alpha[e, going]
                logs[going] += np.log(scale)
                alpha[max(0, e - longest) : e + 1, going] /= scale
                last[going] = 1.0
        return logs + np.log(last)

    def _long(self, word: str) -> np.ndarray:
        """The forward algorithm over one word, ``TOGETHER`` code points at a time."""
        probs, longest = self.probs.astype(np.float64), pieces(self.vocabulary)[1]
        alpha, logs = np.ones((1, len(self.langs))), np.zeros(len(self.langs))
        for lo in range(0, len(word), TOGETHER):
            back = min(lo, longest - 1)
            end, length, piece = self._arcs(word[lo - back : lo + TOGETHER])
            order = np.argsort(end, kind="stable")
            end, length, piece = end[order], length[order], piece[order]
            n = min(TOGETHER, len(word) - lo)
            # alpha ends at ``lo``; arcs from before it begin in its last rows
            base = len(alpha) - 1
            alpha = np.concatenate([alpha, np.zeros((n, len(self.langs)))])
            cut = np.searchsorted(end, np.arange(back + 1, back + n + 2))
            for e in range(1, n + 1):
                here = slice(cut[e - 1], cut[e])
                reach = length[here] <= min(base + e, lo + e)
                alpha[base + e] = (alpha[base + e - length[here][reach]] * probs[piece[here][reach]]).sum(0)
                if e % SCALED == 0:
                    scale = alpha[base + e].copy()
                    logs += np.log(scale)
                    alpha[max(0, base + e - longest) : base + e + 1] /= scale
            alpha = alpha[-longest:].copy()
        return logs + np.log(alpha[-1])

    def _learn(self, tokens: list[str]) -> None:
        """Keep the scores of tokens, the sums of those of their words."""
        cut = [_RUNS(t) for t in tokens]
        new = list(set().union(*cut).difference(self.words))
        first = sum(map(len, self.rows))
        self.rows.append(self.logs(new) if new else np.zeros((0, len(self.langs))))
        self.words.update(zip(new, range(first, first + len(new)), strict=True))
        several = []
        for t, ws in zip(tokens, cut, strict=True):
            if len(ws) == 1:
                self.tokens[t] = self.words[ws[0]]
            else:
                several.append((t, ws))
        if several:
            rows, total, first = np.concatenate(self.rows), np.zeros((len(several), len(self.langs))), first + len(new)
            for i, (_, ws) in enumerate(several):
                for w in ws:
                    total[i] += rows[self.words[w]]
            self.rows.append(total)
            self.tokens.update((t, first + i) for i, (t, _) in enumerate(several))

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text, ``SLICE`` characters at a time."""
        out, held, size = [], [], 0
        for t in texts:
            held.append(t)
            size += len(t or "")
            if size > SLICE:
                out += self._slice(held)
                held, size = [], 0
        return out + self._slice(held)

    def _slice(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        told = [i for i, t in enumerate(texts) if self.langs and t and has_letter(t)]
        if not told:
            return out
        cut = [texts[i].lower().split() for i in told]
        if self.rows and len(self.rows[0]) > min(CACHE, CELLS // len(self.langs)):
            self.forget()
        self._learn(list(set().union(*cut).difference(self.tokens)))
        self.rows = [np.concatenate(self.rows)]
        size = np.array([len(ws) for ws in cut])
        row = np.fromiter(map(self.tokens.__getitem__, chain.from_iterable(cut)), np.int64, int(size.sum()))
        total = np.add.reduceat(self.rows[0][row], np.cumsum(size) - size, axis=0)
        odds = np.exp(total - total.max(axis=1, keepdims=True))
        best = total.argmax(axis=1)
        score = odds.max(axis=1) / odds.sum(axis=1)
        for i, k, x in zip(told, best.tolist(), score.tolist(), strict=True):
            out[i] = self.langs[k], x
        return out

    def text(self, text: str | None) -> tuple[str, float]:
        return self._slice([text])[0]

    def word(self, word: str) -> np.ndarray:
        """log of the word's probability in each language."""
        return self.logs([word])[0]


def labelled(id_col: str = "doc_id") -> Column:
    """Rows that may be learned from: crc32 of the id as text is not 2 modulo 4."""
    return ~held_out(id_col)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@alone("language")
def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by: dict[str, Counter] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            by.setdefault(lang, Counter()).update(_RUNS((text or "").lower()))
        rows = [(lang, w, n) for lang, c in by.items() for w, n in c.items()]
        cols = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["lang", "word", "n"])


def _summed(start: np.ndarray, end: np.ndarray, word: np.ndarray, weight: np.ndarray, logs: np.ndarray) -> None:
    """Fill ``logs`` (place, word) at ``end`` with the log of the sum over arcs of their weights and what is at ``start``, in ascending order of ``end``."""
    order = np.lexsort((word, end))
    start, end, word, weight = start[order], end[order], word[order], weight[order]
    places, cut = np.unique(end, return_index=True)
    for e, lo, hi in zip(places.tolist(), cut.tolist(), [*cut[1:].tolist(), len(end)], strict=True):
        w = word[lo:hi]
        x = logs[start[lo:hi], w] + weight[lo:hi]
        first = np.flatnonzero(np.diff(w, prepend=-1))
        most = np.maximum.reduceat(x, first)
        total = np.add.reduceat(np.exp(x - np.repeat(most, np.diff(first, append=len(w)))), first)
        logs[e, w[first]] = most + np.log(total)


def expected(model: Model, at: int, held: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected counts of pieces in parts of words, so many of each, by the probabilities of language ``at`` (forward and backward)."""
    size = np.array([len(x) for x in held], np.int64)
    begin = np.cumsum(size + 1) - size - 1
    end, length, piece = model._arcs("\n".join(held))
    word = np.searchsorted(begin, end - 1, side="right") - 1
    end = end - begin[word]
    inside = end <= size[word]  # line feeds are a step beyond their word
    word, end, length, piece = word[inside], end[inside], length[inside], piece[inside]
    start, weight, longest = end - length, np.log(model.probs[:, at].astype(np.float64))[piece], int(size.max())
    before, after = np.zeros((longest + 1, len(held))), np.zeros((longest + 1, len(held)))
    _summed(start, end, word, weight, before)
    # places are counted from each word's end
    _summed(size[word] - end, size[word] - start, word, weight, after)
    share = np.exp(before[start, word] + weight + after[size[word] - end, word] - before[size[word], word])
    return np.bincount(piece % len(model.probs), counts[word] * share, len(model.probs))


def _expected(model):
    """Expected counts of pieces, by language, over words whose language is known."""

    @alone("language")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        got = np.zeros(m.probs.shape)
        where = {lang: i for i, lang in enumerate(m.langs)}
        for batch in batches:
            by: dict[str, list[tuple[str, int]]] = {}
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
                by.setdefault(lang, []).extend((part, n) for part in parts(word))
            for lang, held in by.items():
                held.sort(key=lambda x: len(x[0]))
                while held:
                    # all words of a group are padded to its longest one
                    k = len(held)
                    while k > 1 and (len(held[k - 1][0]) + 1) * k > TOGETHER:
                        k = -(-k // 2)
                    some, held = held[:k], held[k:]
                    got[:, where[lang]] += expected(m, where[lang], [x for x, _ in some], np.array([n for _, n in some], np.float64))
        piece, lang = np.nonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(piece, pa.int32()), pa.array(got[piece, lang])], ["l", "p", "n"])

    return run


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", vocabulary: str = VOCABULARY, sample: int | None = None, rounds: int = ROUNDS) -> Model:
    """Fit on all rows of ``docs`` with a language, or if ``sample`` is given on those so many whose ids' hashes are smallest.

    To the driver come the languages' names and rounds x languages x pieces numbers.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.lit("sample"), F.col(id_col)).alias("_h")).where("text is not null and lang is not null")
    most = None if sample is None else rows.select("_h").orderBy("_h").limit(sample).agg(F.max("_h")).first()[0]
    if most is not None:
        rows = rows.where(F.col("_h") <= most)
    counted = rows.select("text", "lang").mapInArrow(_words, "lang string, word string, n long")
    counted = stage(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    langs = sorted(r[0] for r in counted.select("lang").distinct().collect())
    known, _ = pieces(vocabulary)
    model = Model(vocabulary, langs, np.full((len(known) + 1, len(langs)), 1.0 / max(1, len(known)), np.float32))
    for _ in range(rounds if langs else 0):
        got = np.zeros(model.probs.shape)
        sums = counted.mapInArrow(_expected(spark.sparkContext.broadcast(model)), "l int, p int, n double")
        for r in sums.groupBy("l", "p").agg(F.sum("n")).collect():
            got[r[1], r[0]] = r[2]
        got[-1] = 0
        probs = (got + _SMOOTH) / (got + _SMOOTH).sum(axis=0)
        probs[-1] = UNSEEN
        model = Model(vocabulary, langs, probs.astype(np.float32))
    return model


def _predict(model, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        with caching("language", m.forget):
            for batch in batches:
                got = m.texts(batch.column(at).to_pylist())
                cols = batch.columns + [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, [f"_{i}" for i in range(len(cols))])

    return run


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None, text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` of every row but those named as ``out``, and the language and score as ``out``; only the text is looked at."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in out]
    told = dict(docs.dtypes)
    # the text goes to Python once, and names stay out of the way
    asked = keep if text_col in keep and told[text_col] == "string" else [*keep, text_col]
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    rows = docs.select(*(quoted(c).cast("string" if i == len(keep) else told[c]).alias(f"_{i}") for i, c in enumerate(asked)))
    schema = ", ".join([*(f"_{i} {t}" for i, (_, t) in enumerate(rows.dtypes)), f"_{len(asked)} string", f"_{len(asked) + 1} double"])
    got = rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model), asked.index(text_col)), schema)
    return got.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(keep)), F.col(f"_{len(asked)}").alias(out[0]), F.col(f"_{len(asked) + 1}").alias(out[1]))
