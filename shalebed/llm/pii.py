"""Personal data: expressions propose spans, checksums confirm them, nearby words adjust the score.

Base kinds (always reported, at score 1 after a passed check): email, ip, card, phone.
Added kinds: iban (mod 97), national (three-two-four digits) and local_phone, whose
scores start below the threshold unless a checksum passed, and rise if one of the
kind's context words stands within ``CONTEXT`` characters before the span.
Offsets count code points, ends are exclusive.

Defined results: a null text is empty and has no spans; very long texts are searched
whole, in time linear in their length; repeated rows are judged each on its own; an
empty table gives no rows. A span of an added kind that overlaps a base span is left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workers import alone

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "national", "local_phone")
THRESHOLD = 0.6
CONTEXT = 40


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where a run of digits begins (one that fails there fails later in the run too), so the
# lookbehind changes no match, and keeps long runs from being tried again at each digit.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])")
_NEAR = {
    "iban": re.compile(r"(?i)\b(?:iban|account|bank|konto|cuenta|compte)\b"),
    "national": re.compile(r"(?i)\b(?:ssn|social security|national id|tax id)\b"),
    "local_phone": re.compile(r"(?i)\b(?:phone|tel|telephone|mobile|call|fax)\b"),
}
_DIGITS = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    x = iban.replace(" ", "")
    return 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain, found from each @ outwards in linear time."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        else:
            end = at + 1  # no later match can reach back over this sign
        at = text.find("@", end)


def base_spans(text: str) -> list[Span]:
    out = [Span("email", a, b, 1.0) for a, b in emails(text)]
    if not _DIGITS.search(text):
        return out
    if "." in text:
        out += [Span("ip", m.start(), m.end(), 1.0) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(Span("card", m.start(), m.end(), 1.0))
    if "+" in text:
        out += [Span("phone", m.start(), m.end(), 1.0) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.findall(m[0])) <= 15]
    return out


def added_spans(text: str, base: list[Span]) -> list[Span]:
    if not _DIGITS.search(text):
        return []
    taken = sorted((s.start, s.end) for s in base)
    out = []
    for kind, form, start_score in (("iban", _IBAN, 0.8), ("national", _NATIONAL, 0.4), ("local_phone", _LOCAL_PHONE, 0.4)):
        for m in form.finditer(text):
            if kind == "iban" and not mod97(m[0]):
                continue
            if any(a < m.end() and m.start() < b for a, b in taken):
                continue
            near = _NEAR[kind].search(text, max(0, m.start() - CONTEXT), m.start())
            score = min(1.0, start_score + (0.3 if near else 0.0))
            if score >= THRESHOLD:
                out.append(Span(kind, m.start(), m.end(), score))
    return out


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans by kind as listed, then start; added spans likewise."""
    base = base_spans(text) if text else []
    return base, added_spans(text, base) if text else []


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by [KIND]; of overlapping spans the earlier (then longer) one names the place."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


_SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"


def _found(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        base, added = find(t)
        rows.append(([s._asdict() for s in base], [s._asdict() for s in added], None if t is None else redact(t, base + added)))
    return pd.DataFrame(rows, columns=["base", "added", "redacted"])


def scan(docs: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` and a struct column ``out``: base and added spans, and the redacted text (null for a null text)."""
    udf = F.pandas_udf(_found, f"base {_SPANS}, added {_SPANS}, redacted string")
    return docs.withColumn(out, udf(F.col(text_col).cast("string")))


def told(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


@alone("pii")
def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for t in batch.column("_text"):
            base, added = find(t.as_py())
            rows.append((*(sum(s.kind == k for s in base) for k in BASE), hashlib.sha256(told(base).encode()).hexdigest(), told(base + added), max((s.score for s in base + added), default=0.0)))
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "top_score"])


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and spans of every row, as text."""
    kind = docs.select(F.col(id_col).alias("i")).dtypes[0][1]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(_digest, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, top_score double")


@alone("pii")
def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for t in batch.column("text"):
            t = t.as_py()
            base, added = find(t)
            out.append(t if not base and not added else redact(t, base + added))
        i = batch.schema.get_field_index("text")
        yield batch.set_column(i, "text", pa.array(out, pa.string()))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` (with a string column ``text``) in which each span of the text is replaced by its kind."""
    return docs.mapInArrow(_redact, docs.schema)
