"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence's probability is a logistic function of its hashed words and their beginnings; the document's is the noisy-or of its sentences'.
Both are trained from document labels alone, by gradient descent on the likelihood of a bounded sample
(``TRAIN_DOCS``, drawn by a hash of the id). The sentence probabilities then say which sentences offend.

Defined results: null or empty texts, and those without a sentence, have score 0; labels that are null are not used, a
document labelled more than once counts as toxic if any label says so; a null id is never in training; repeated rows
are scored alike; without a label of either kind nothing is learned and every score is 0; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import table
from .bytesvec import U, prefix, sliced, stretch, words
from .common import modest_batches, small

TRAIN_DOCS, FOLDS = 8000, 5
#: Bytes of a word's beginnings that are features beside the word.
PREFIXES = (4, 5, 6)
BITS, LEAST_DOCS, MARGIN, EPOCHS, RATE, DECAY, BIAS = 20, 3, 2.0, 200, 0.15, 1e-4, -7.0
TOKEN = np.arange(256, dtype=np.uint8)
TOKEN[65:91] += 32
TOKEN[[i for i in range(128) if not (48 <= i < 58 or 65 <= i < 91 or 97 <= i < 123 or i == 39)]] = 32
BREAK = np.zeros(256, bool)
BREAK[[10, 33, 46, 63]] = True


def sentences(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Features (a row for the words, one for each length of prefix) and sentence of every word; row, start and end of
    every sentence that has one."""
    token = TOKEN[data]
    start, end = words(token, rows)
    if not len(start):
        return np.zeros((1 + len(PREFIXES), 0), np.int64), *((np.zeros(0, np.int64),) * 4)
    sums = prefix(token)
    ends = [end, *(np.minimum(start + n, end) for n in PREFIXES)]
    feature = np.stack([(stretch(sums, start, e) >> U(64 - BITS)).astype(np.int64) for e in ends])
    stops = np.concatenate(([0], np.cumsum(BREAK[data])))[start]
    row = np.searchsorted(rows, start, "right") - 1
    new = np.concatenate(([True], (stops[1:] != stops[:-1]) | (row[1:] != row[:-1])))
    at = np.flatnonzero(new)
    return feature, np.cumsum(new) - 1, row[at], start[at], end[np.append(at[1:], len(end)) - 1]


def present(feature: np.ndarray, of: np.ndarray, known: np.ndarray) -> np.ndarray:
    """``of << BITS | feature`` for the known features, each once; of: sentence or document of every word."""
    return np.unique(np.concatenate([of[k] << BITS | f[k] for f in feature for k in (known[f],)]))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def telling(of: np.ndarray, in_toxic: np.ndarray, rate: float) -> np.ndarray:
    """Which features' documents are toxic more or less often than all are, beyond what chance explains with so many
    features tried (a likelihood-ratio test)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.nan_to_num(in_toxic * np.log(in_toxic / (of * rate))) + np.nan_to_num((of - in_toxic) * np.log((of - in_toxic) / (of * (1 - rate))))
    tried = of >= LEAST_DOCS
    return tried & (gain > np.log(max(2, tried.sum())) + MARGIN)


def train(texts: pa.Array, toxic: np.ndarray) -> np.ndarray:
    """Weights of the features, and last the bias."""
    w = np.zeros((1 << BITS) + 1)
    w[-1] = -60
    if toxic.all() or not toxic.any():
        return w
    of, in_toxic = np.zeros(1 << BITS), np.zeros(1 << BITS)
    every = np.ones(1 << BITS, bool)
    for lo, hi, data, rows in sliced(texts):
        f, s, row, _, _ = sentences(data, rows)
        pair = present(f, row[s], every)
        of += np.bincount(pair & ((1 << BITS) - 1), minlength=1 << BITS)
        in_toxic += np.bincount(pair[toxic[lo:hi][pair >> BITS]] & ((1 << BITS) - 1), minlength=1 << BITS)
    known = telling(of, in_toxic, toxic.mean())
    pairs, docs, n = [], [], 0
    for lo, _, data, rows in sliced(texts):
        f, s, row, _, _ = sentences(data, rows)
        pairs.append(present(f, s, known) + (n << BITS))
        docs.append(row + lo)
        n += len(row)
    pair, d = np.concatenate(pairs), np.concatenate(docs)
    at = np.flatnonzero(known)
    s, f = pair >> BITS, np.searchsorted(at, pair & ((1 << BITS) - 1))
    theta, bias = np.zeros(len(at)), BIAS
    m, v = np.zeros(len(at) + 1), np.zeros(len(at) + 1)
    for epoch in range(1, EPOCHS + 1):
        z = bias + np.bincount(s, theta[f], n)
        total = np.bincount(d, _softplus(z), len(toxic))
        pull = np.where(toxic, -1 / np.expm1(np.clip(total, 1e-6, 50)), 1.0)
        slope = pull[d] / (1 + np.exp(-z))
        g = np.append(np.bincount(f, slope[s], len(at)), slope.sum()) / len(toxic)
        g[:-1] += DECAY * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
        theta, bias = theta - step[:-1], bias - step[-1]
    w[at], w[-1] = theta, bias
    return w


def _fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [b for b in batches if b.num_rows]
    t = pa.Table.from_batches(got).combine_chunks() if got else None
    w = train(t.column(0).combine_chunks(), t.column(1).to_numpy() > 0) if t else train(pa.array([], pa.string()), np.zeros(0, bool))
    yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f4").tobytes()])], ["w"])


def fold(id_col: str, folds: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = FOLDS, train_docs: int = TRAIN_DOCS) -> np.ndarray:
    """Learns from labelled documents whose id's crc32 modulo ``folds`` is not 0, from about ``train_docs`` of them."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).filter(fold(id_col, folds) != 0)
    known = known.groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).alias("y"))
    n = known.count()
    drawn = known.filter(F.pmod(F.xxhash64("i"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, train_docs / max(1, n))))
    rows = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("text")).join(small(drawn), F.col("d") == F.col("i")).select("text", F.col("y").cast("int").alias("y"), "d")
    rows = rows.repartition(1).sortWithinPartitions("d").drop("d")  # the sample's bound is that of this task
    found = rows.mapInArrow(_fit, "w binary").first()
    return np.frombuffer(found["w"], "<f4").astype(np.float64) if found else train(pa.array([], pa.string()), np.zeros(0, bool))


def _score(batches: Iterable[pa.RecordBatch], w: np.ndarray, spans: bool) -> Iterator[pa.RecordBatch]:
    known = w[:-1] != 0
    for b in batches:
        score, many, offend = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
        found: list[list] = [[] for _ in range(b.num_rows)] if spans else []
        for lo, hi, data, rows in sliced(b.column(b.num_columns - 1)):
            f, s, row, start, end = sentences(data, rows)
            if not len(row):
                continue
            pair = present(f, s, known)
            z = w[-1] + np.bincount(pair >> BITS, w[pair & ((1 << BITS) - 1)], len(row))
            score[lo:hi] = -np.expm1(-np.bincount(row, _softplus(z), hi - lo))
            many[lo:hi] = np.bincount(row, minlength=hi - lo)
            offend[lo:hi] = np.bincount(row[z >= 0], minlength=hi - lo)
            for k in np.flatnonzero(z >= 0).tolist() if spans else ():
                at = rows[row[k]]
                p = 1 / (1 + np.exp(-z[k]))
                found[lo + row[k]].append({"start": int(start[k] - at), "end": int(end[k] - at), "p": float(p), "sentence": data[start[k] : end[k]].tobytes().decode(errors="replace")})
        cols = [pa.array(score), pa.array(many), pa.array(offend)]
        names = ["score", "n_sentences", "n_offending"]
        if spans:
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64()), ("sentence", pa.string())]))
            cols.append(pa.array(found, kind))
            names.append("offending")
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], [*b.schema.names[:-1], *names])


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, spans: bool = False) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_sentences, n_offending``; with ``spans`` the offending sentences and their byte places."""
    modest_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(id_col, folds) == 0).alias("held_out"), F.col(text_col).alias("text"))
    kind = "doc_id long, held_out boolean, score double, n_sentences long, n_offending long" + ", offending array<struct<start:long,end:long,p:double,sentence:string>>" * spans
    out = rows.mapInArrow(lambda it: _score(it, sent.value, spans), kind)
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), *out.columns[3:])


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")), spans=True)
