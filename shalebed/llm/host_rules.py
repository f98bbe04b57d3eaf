"""Quality rules whose failures are judged host by host.

Each document gets counts and rule failures; failures are summed by host, each host's
rate of each rule is shrunk towards all hosts' rate by a beta prior fitted to the hosts
(method of moments), and a host whose shrunk rate of any rule passes ``MOST`` is
rejected with all of its documents. A document is dropped if it fails a base rule
itself or its host is rejected.

Defined results: a null text has no words and fails the base rule; null hosts form one
host of their own; repeated rows count each time; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import stage
from .words import flat_hashes, rolling, slices, window_starts, words
from .workers import alone

#: A host is rejected if the shrunk rate of one of its rules is above this.
MOST = 0.5
_SYMBOLS = b"#*$%&|<>"
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"

#: rule -> failure, as SQL over the counts. The first two are the base rules.
RULES = {
    "few_words": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "long_words": "word_chars > 12 * n_words",
    "dup_lines": "20 * n_dup_lines > n_words",
}


def repeated(docs: list[list[bytes]], k: int = 5) -> np.ndarray:
    """Words of each document that lie in a window of k words found at least twice in it."""
    flat, off = flat_hashes(docs)
    place, doc = window_starts(off, k)
    out = np.zeros(len(docs), np.int64)
    if not len(place):
        return out
    h = rolling(flat, k)[place]
    order = np.lexsort((h, doc))
    h, d, p = h[order], doc[order], place[order]
    same = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
    if not same.any():
        return out
    twice = np.zeros(len(h), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(flat) + 1, np.int64)
    np.add.at(edge, p[twice], 1)
    np.add.at(edge, p[twice] + k, -1)
    covered = np.cumsum(edge[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(covered)])
    return total[off[1:]] - total[off[:-1]]


@alone("host_rules")
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chars = pc.fill_null(pc.utf8_length(batch.column("_text")), 0).to_numpy(zero_copy_only=False)
        got = []
        for start, texts in slices(batch.column("_text")):
            docs = [words(x) for x in texts]
            again = repeated(docs)
            for i, (b, ws) in enumerate(zip(texts, docs, strict=True)):
                b = b or b""
                lines = [x for x in b.split(b"\n") if x.strip()]
                got.append((
                    len(ws),
                    sum(map(len, ws)) - (len(b) - int(chars[start + i])),
                    len(b) - len(b.translate(None, _SYMBOLS)),
                    len(lines) - len(set(lines)),
                    int(again[i]),
                ))
        cols = zip(*got, strict=True) if got else [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_host"), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "host", *(c.split()[0] for c in COUNTS.split(", "))])


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | str = "source") -> DataFrame:
    """doc_id, host and the five counts of every row."""
    host = F.col(host) if isinstance(host, str) else host
    kind = docs.select(F.col(id_col).alias("i")).dtypes[0][1]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), host.cast("string").alias("_host"))
    return rows.mapInArrow(_count, f"doc_id {kind}, host string, {COUNTS}")


def prior(mean: float, var: float, n: float) -> tuple[float, float]:
    """alpha, beta of a beta prior with this mean and variance of the true rates, from hosts of n rows at the harmonic mean.

    The variance of the observed rates holds that of sampling, which is taken off first.
    """
    if not 0 < mean < 1:
        return (mean + 1e-3) * 2, (1 - mean + 1e-3) * 2
    own = max(var - mean * (1 - mean) / max(n, 1.0), 1e-6)
    total = min(max(mean * (1 - mean) / own - 1, 2.0), 1e4)
    return mean * total, (1 - mean) * total


def verdicts(counted: DataFrame, most: float = MOST) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """_host, n, a shrunk rate for each rule and host_ok of every host; the priors."""
    fails = [F.sum(F.expr(f"if({x}, 1, 0)")).alias(f"f_{r}") for r, x in RULES.items()]
    hosts = counted.groupBy(_host_key().alias("_host")).agg(F.count(F.lit(1)).alias("n"), *fails)
    rates = [x for r in RULES for x in (F.avg(F.col(f"f_{r}") / F.col("n")).alias(f"m_{r}"), F.coalesce(F.var_samp(F.col(f"f_{r}") / F.col("n")), F.lit(0.0)).alias(f"v_{r}"))]
    # one row, whatever the number of hosts
    seen = hosts.agg(F.coalesce(F.count(F.lit(1)) / F.sum(1 / F.col("n")), F.lit(1.0)).alias("n"), *rates).first()
    priors = {r: prior(seen[f"m_{r}"] or 0.0, seen[f"v_{r}"] or 0.0, seen["n"]) for r in RULES}
    shrunk = [((F.col(f"f_{r}") + F.lit(a)) / (F.col("n") + F.lit(a + b))).alias(f"rate_{r}") for r, (a, b) in priors.items()]
    out = hosts.select("_host", "n", *shrunk)
    return out.withColumn("host_ok", F.greatest(*(F.col(f"rate_{r}") for r in RULES)) <= most), priors


def _host_key() -> Column:
    return F.when(F.col("host").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("host")))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | str = "source", most: float = MOST) -> DataFrame:
    """doc_id, host, the counts, base_failed, host_ok and kept of every row."""
    counted = stage(counts(docs, id_col, text_col, host), "rule-counts")
    hosts, _ = verdicts(counted, most)
    failed = " or ".join(f"({RULES[r]})" for r in ("few_words", "repeats"))
    joined = counted.withColumn("_host", _host_key()).join(hosts.select("_host", "host_ok"), "_host", "left").drop("_host")
    return joined.withColumn("base_failed", F.expr(failed)).withColumn("kept", ~F.col("base_failed") & F.col("host_ok"))
