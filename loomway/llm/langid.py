"""Language identification by multilingual mixture inference.

Each word of a document is emitted by one of the languages, with the likelihood of its byte trigrams there; expectation
maximisation estimates the document's proportions of languages. The set of languages is chosen by penalised likelihood
among the likeliest one, two and so on up to all that were learned. The language with the largest proportion is predicted, its proportion the score.

Trigram counts come from a bounded sample of documents per language (``TRAIN_DOCS``, drawn by a hash of the id).

Defined results: a text that is null or has no letter is ``und`` with score 0, as is any text if no language was
learned; a null language is not learned from; a null id is as an empty one; repeated rows get the same result; ties go
to the language that comes first by code point; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import table
from .bytesvec import sliced, words
from .common import modest_batches, small
from .toxicity import fold

TRAIN_DOCS, FOLDS = 1500, 3
BITS, SMOOTH, ROUNDS, PENALTY = 16, 0.5, 8, 3.0
UNKNOWN = "und"
#: Letters in lower case; all else that is ASCII is a space.
LETTER = np.full(256, 32, np.uint8)
LETTER[128:] = np.arange(128, 256)
LETTER[97:123] = LETTER[65:91] = np.arange(97, 123)


def grams(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and word of each trigram, the space around a word included; row of each word."""
    text = LETTER[data]
    start, end = words(text, rows)
    if not len(start):
        return (np.zeros(0, np.int64),) * 3
    n = end - start
    word = np.repeat(np.arange(len(start)), n)
    at = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
    before = np.where(at == start[word], 32, text[at - 1]).astype(np.uint64)
    after = np.where(at == end[word] - 1, 32, text[np.minimum(at + 1, len(text) - 1)]).astype(np.uint64)
    code = (before << np.uint64(16)) | (text[at].astype(np.uint64) << np.uint64(8)) | after
    bucket = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)
    return bucket, word, np.searchsorted(rows, start, "right") - 1


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for b in batches:
        lang = b.column(0).to_pylist()
        for lo, hi, data, rows in sliced(b.column(1)):
            bucket, word, row = grams(data, rows)
            of = row[word] + lo if len(word) else word
            for name in set(lang[lo:hi]):
                own = np.array([x == name for x in lang], bool)[of] if len(of) else np.zeros(0, bool)
                total[name] = total.get(name, 0) + np.bincount(bucket[own], minlength=1 << BITS)
    for name, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], ["lang", "bucket", "n"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = FOLDS, train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Names of the languages, and the log-likelihood of each trigram bucket in each; learned where the id's crc32 modulo ``folds`` is not 1."""
    known = docs.filter(F.col(lang_col).isNotNull()).filter(fold(id_col, folds) != 1)
    sizes = small(known.groupBy(F.col(lang_col).alias("l")).agg(F.count("*").alias("of")))
    drawn = known.join(sizes, F.col(lang_col) == F.col("l")).filter(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) < F.lit(float(1 << 30)) * train_docs / F.col("of"))
    counts = drawn.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(_count, "lang string, bucket int, n long")
    found = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()  # buckets times languages at most
    names = sorted({r["lang"] for r in found})
    n = np.full((len(names), 1 << BITS), SMOOTH)
    at = {x: i for i, x in enumerate(names)}
    for r in found:
        n[at[r["lang"]], r["bucket"]] += r["n"]
    return names, np.log(n / n.sum(1, keepdims=True)) if names else n


def mixture(like: np.ndarray, weight: np.ndarray, doc: np.ndarray, n: int, allowed: np.ndarray, *rounds: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Proportions of the allowed languages in each of n documents, and the log-likelihood, after each of these numbers
    of rounds, which ascend; like: words x languages."""
    found = []
    starts = np.searchsorted(doc, np.arange(n))
    some = starts < np.append(starts[1:], len(doc))
    pi = allowed / allowed.sum(1, keepdims=True)
    mass = np.maximum(np.bincount(doc, weight, n), 1)[:, None]
    for i in range(rounds[-1] + 1):
        with np.errstate(divide="ignore"):
            a = like + np.log(pi)[doc]
        top = a.max(1)
        np.exp(a - top[:, None], out=a)
        total = a.sum(1)
        if i in rounds:
            found.append((pi, np.bincount(doc, np.log(total) + top, n)))
            if i == rounds[-1]:
                return found
        a *= (weight / total)[:, None]
        new = np.zeros_like(pi)
        new[some] = np.add.reduceat(a, starts[some])
        pi = new / mass
    raise AssertionError


def _predict(batches: Iterable[pa.RecordBatch], names: list[str], like: np.ndarray) -> Iterator[pa.RecordBatch]:
    k = max(1, len(names))
    for b in batches:
        lang, score, langs = np.full(b.num_rows, -1), np.zeros(b.num_rows), np.zeros(b.num_rows, np.int32)
        texts = b.column(b.num_columns - 1)
        for lo, hi, data, rows in sliced(texts, max(1 << 16, (8 << 20) // k)) if names else ():
            bucket, word, row = grams(data, rows)
            if not len(row):
                continue
            per = np.stack([np.bincount(word, like[i][bucket], len(row)) for i in range(k)], 1)
            weight = np.bincount(word, minlength=len(row)).astype(float)
            n = hi - lo
            whole, (pi, _) = mixture(per, weight, row, n, np.ones((n, k)), ROUNDS // 2, ROUNDS)
            order = np.argsort(-pi, 1, kind="stable")
            best, cost = pi, np.full(n, np.inf)
            used = np.zeros(n, np.int32)
            m = np.maximum(np.bincount(row, minlength=n), 2)
            for size in range(1, k + 1):
                allowed = np.zeros((n, k))
                np.put_along_axis(allowed, order[:, :size], 1, 1)
                part, fit_ = whole if size == k else mixture(per, weight, row, n, allowed, ROUNDS // 2 if size > 1 else 0)[0]
                c = -fit_ + PENALTY * (size - 1) * np.log(m)
                won = c < cost
                best, cost, used = np.where(won[:, None], part, best), np.where(won, c, cost), np.where(won, size, used)
            has = np.bincount(row, minlength=n) > 0
            plain = np.zeros(len(data) + 1, np.int64)
            np.cumsum((LETTER[data] > 96) & (LETTER[data] < 123), out=plain[1:])
            for i in np.flatnonzero(has & (plain[rows[1:]] == plain[rows[:-1]])).tolist():  # perhaps marks only, no letter
                has[i] = any(c.isalpha() for c in texts[lo + i].as_py())
            lang[lo:hi] = np.where(has, best.argmax(1), -1)
            score[lo:hi] = np.where(has, np.clip(best.max(1), 0, 1), 0)
            langs[lo:hi] = np.where(has, used, 0)
        out = [names[i] if i >= 0 else UNKNOWN for i in lang.tolist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.string()), pa.array(score), pa.array(langs)], [*b.schema.names[:-1], "lang_pred", "score", "n_langs"])


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, n_langs``; the last is how many languages the text was found to mix."""
    modest_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(id_col, folds) == 1).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda it: _predict(it, *sent.value), "doc_id long, held_out boolean, lang_pred string, score double, n_langs int")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
