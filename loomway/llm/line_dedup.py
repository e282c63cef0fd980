"""Line dedup: a sharded minimal perfect hash over the distinct lines' hashes indexes compact arrays, and documents probe
the arrays instead of joining lines.

1. A line's key is the line stripped of white space with A-Z lower-cased, hashed to 128 bits. The keys of a document are
   written once, with the numbers of the lines that have them; texts are read for that and not again until the end.
2. Keys are counted over all documents (partial sums before the shuffle, so a very common line is one row per task). The
   distinct ones are put, shard by shard, under a minimal perfect hash with arrays: fingerprint, count, the document that
   keeps them.
3. Keys probe the arrays of their shard, which is read once and kept while its probes stream by; what comes back are
   numbers of lines to drop. Keys of more than ``HOT_SHARE`` of all lines (as many as one over that, at most) have an
   index of their own that every task holds, so that a very common line is probed where it is.
4. Documents with lines to drop meet their numbers; the others are not moved.

Defined results: a null or empty text is one empty line; each row counts as a document, rows that share the largest
id all keep their lines; null ids are below all others; an empty table gives an empty result; other columns are
carried along untouched, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import materialize, table
from .common import flag_perhaps, modest_batches, with_new_text

SPACES = b" \t\n\x0b\x0c\r"
U = np.uint64
LEVELS = 40
HOT_SHARE, LEAST_HOT = 1e-4, 1000


def keys_of(text: str, least: int) -> Iterator[tuple[int, bytes]]:
    """Index and digest of each line whose key has at least ``least`` code points."""
    for i, line in enumerate(text.split("\n")):
        if len(line) >= least:
            key = line.encode().strip(SPACES).lower()
            if len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least):
                yield i, xxhash.xxh3_128_digest(key)


def _mix(k: np.ndarray, level: int) -> np.ndarray:
    """A hash of keys (rows of two numbers) for each level."""
    h = (k[:, 0] ^ U((level * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & (1 << 64) - 1)) * U(0xFF51AFD7ED558CCD)
    h ^= (h >> U(33)) ^ k[:, 1]
    h *= U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


class PerfectHash:
    """Minimal perfect hash: each level keeps the keys that have a bit of its array to themselves, the rest go on."""

    def __init__(self, keys: np.ndarray):
        self.levels, base, left = [], 0, keys
        for level in range(LEVELS):
            if not len(left):
                break
            size = 2 * len(left) + 1
            at = (_mix(left, level) % U(size)).astype(np.int64)
            own = np.bincount(at, minlength=size) == 1
            bits = np.packbits(own, bitorder="little")
            ranks = np.concatenate(([0], np.cumsum(np.add.reduceat(own.astype(np.int64), np.arange(0, size, 8))))).astype(np.int64) + base
            self.levels.append((size, bits, ranks.astype(np.uint32)))
            base += int(own.sum())
            left = left[~own[at]]
        self.size, self.rest = base, {(a, b): base + i for i, (a, b) in enumerate(left.tolist())}

    def find(self, keys: np.ndarray) -> np.ndarray:
        """A slot for each key, that of a stored key if it is one; -1: surely none."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, bits, ranks) in enumerate(self.levels):
            at = (_mix(keys[left], level) % U(size)).astype(np.int64)
            byte, bit = bits[at >> 3], (at & 7).astype(np.uint8)
            hit = (byte >> bit) & 1 == 1
            low = np.bitwise_count(byte & ((1 << bit.astype(np.uint16)) - 1).astype(np.uint8))
            out[left[hit]] = (ranks[at >> 3].astype(np.int64) + low)[hit]
            left = left[~hit]
            if not len(left):
                break
        for i in left.tolist() if self.rest else ():
            out[i] = self.rest.get(tuple(keys[i].tolist()), -1)
        return out


class Shard:
    """The hash of some keys with arrays in the order of its slots."""

    def __init__(self, keys: np.ndarray, count: np.ndarray, keeper: np.ndarray, no_keeper: np.ndarray):
        self.hash = PerfectHash(keys)
        slot, n = self.hash.find(keys), len(keys)
        self.print, self.count, self.keeper, self.none = np.zeros(n, np.uint32), np.zeros(n, np.uint32), np.zeros(n, np.int64), np.zeros(n, bool)
        self.print[slot], self.count[slot], self.keeper[slot], self.none[slot] = keys[:, 1] >> U(32), np.minimum(count, 0xFFFFFFFF), keeper, no_keeper

    @staticmethod
    def of(rows: pd.DataFrame) -> Shard:
        keys = np.stack([rows[k].to_numpy().astype(np.int64).view(U) for k in ("k1", "k2")], 1)
        return Shard(keys, rows["n"].to_numpy(), rows["keeper"].fillna(0).to_numpy().astype(np.int64), rows["keeper"].isna().to_numpy())

    def probe(self, keys: np.ndarray, ids: np.ndarray, null: np.ndarray, min_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are stored, and which of them are frequent lines that their document does not keep."""
        slot = self.hash.find(keys) if len(self.print) else np.full(len(keys), -1)
        known = slot >= 0
        slot = np.where(known, slot, 0) if len(self.print) else slot
        if not len(self.print):
            return known, known
        known &= self.print[slot] == (keys[:, 1] >> U(32)).astype(np.uint32)
        keeps = np.where(self.none[slot], null, ~null & (ids == self.keeper[slot]))
        return known, known & (self.count[slot] >= min_docs) & ~keeps


LINES = "id long, th long, k1 long, k2 long, lines array<int>"
NAMES = ["id", "th", "k1", "k2", "lines"]


def _keyed(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The distinct keys of each document with the numbers of their lines."""
    for b in batches:
        ids, ths, got, lines = [], [], [], []
        for doc, th, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            own: dict[bytes, list[int]] = {}
            for i, k in keys_of(text or "", least):
                own.setdefault(k, []).append(i)
            got += own
            lines += own.values()
            ids += [doc] * len(own)
            ths += [th] * len(own)
        k = np.frombuffer(b"".join(got), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ths, pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(lines, pa.list_(pa.int32()))], NAMES)


def _parts(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, ids (0 where null) and where they are null."""
    col = lambda c: b.column(b.schema.get_field_index(c))
    keys = np.stack([col(k).to_numpy(zero_copy_only=False).astype(np.int64).view(U) for k in ("k1", "k2")], 1)
    return keys, col("id").fill_null(0).to_numpy(), col("id").is_null().to_numpy(zero_copy_only=False)


def _probe_hot(batches: Iterable[pa.RecordBatch], shard: Shard, min_docs: int) -> Iterator[pa.RecordBatch]:
    """Settles the very common keys: those to drop have ``drop`` set, those to keep are gone, the others go on."""
    for b in batches:
        known, take = shard.probe(*_parts(b), min_docs)
        stay = pa.array(~known | take)
        yield pa.RecordBatch.from_arrays([*(c.filter(stay) for c in b.columns), pa.array(take).filter(stay)], [*b.schema.names, "drop"])


def _probe(batches: Iterable[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Of a partition in which each shard's index is followed by its probes: documents and lines to drop."""
    shard = None
    for b in batches:
        index = b.column(b.schema.get_field_index("index"))
        heads = np.flatnonzero(index.is_valid().to_numpy(zero_copy_only=False)).tolist()
        for lo, hi in zip([-1, *heads], [*heads, b.num_rows]):
            if lo >= 0:
                shard = pickle.loads(index[lo].as_py())
            if hi > lo + 1:
                part = b.slice(lo + 1, hi - lo - 1)
                take = pa.array(shard.probe(*_parts(part), min_docs)[1])
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)).filter(take) for c in ("id", "th", "lines")], ["id", "th", "lines"])


def _build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"shard": [int(key[0])], "index": [pickle.dumps(Shard.of(pdf))]})


def lines_to_drop(texts: DataFrame, least: int, min_docs: int, shard_keys: int) -> DataFrame:
    """``id, th, gone`` for documents ``id, th, text`` that lose lines: the numbers of these. th: a hash of the text."""
    spark = texts.sparkSession
    lines = materialize(texts.mapInArrow(lambda it: _keyed(it, least), LINES))
    found = materialize(lines.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("id").alias("keeper")))
    total, distinct = found.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    hot = Shard.of(found.filter(F.col("n") > max(LEAST_HOT, total * HOT_SHARE)).toPandas())  # fewer than 1 / HOT_SHARE rows
    sent = spark.sparkContext.broadcast(hot)
    now = lines.mapInArrow(lambda it: _probe_hot(it, sent.value, min_docs), f"{LINES}, drop boolean")
    shards = max(1, -(-distinct // shard_keys))
    shard = F.pmod(F.xxhash64("k1"), F.lit(shards)).alias("shard")
    built = found.withColumn("shard", shard).groupBy("shard").applyInPandas(_build, "shard long, index binary")
    none = {c: F.lit(None).cast(k) for c, k in (x.split() for x in LINES.split(", "))}
    rows = built.withColumns(none).unionByName(now.filter("not drop").select("*", shard, F.lit(None).cast("binary").alias("index")).drop("drop"))
    rows = rows.repartition("shard").sortWithinPartitions("shard", F.col("index").isNull())
    gone = rows.mapInArrow(lambda it: _probe(it, min_docs), "id long, th long, lines array<int>").unionByName(now.filter("drop").select("id", "th", "lines"))
    # rows that repeat id and text have the same lines; a set holds them once
    return materialize(gone.groupBy("id", "th").agg(F.array_distinct(F.flatten(F.collect_set("lines"))).alias("gone")))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 40, min_docs: int = 5, shard_keys: int = 50_000) -> DataFrame:
    """``row`` (the input row as a struct), ``n_lines``, ``n_dropped`` and ``kept_text``."""
    modest_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    gone = lines_to_drop(texts, least, min_docs, shard_keys).withColumnRenamed("th", "t")
    rows = flag_perhaps(docs, F.col(text_col), gone.select("t"), hashed=True)
    text = F.col("row").getField(text_col)
    mine = F.col("row").getField(id_col).cast("long").eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("t"))
    some = rows.filter("perhaps").join(gone.hint("merge"), mine, "left").select("row", "gone")  # texts move once, at every size
    rows = some.unionByName(rows.filter("not perhaps").select("row", F.lit(None).cast("array<int>").alias("gone")))
    rows = rows.select("row", "gone", F.coalesce(text, F.lit("")).alias("body")).withColumn("said", F.split("body", "\n"))
    left = F.when(F.col("gone").isNull(), F.col("body")).otherwise(F.array_join(F.filter("said", lambda x, i: ~F.array_contains("gone", i)), "\n"))
    return rows.select("row", F.size("said").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), left.alias("kept_text"))


def without_shared_lines(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars", **options) -> DataFrame:
    """The documents with their shared lines dropped; same columns. ``size_col``, if there, is counted anew."""
    out = drop_lines(docs, text_col=text_col, **options).select("row", F.col("kept_text").alias("text"))
    return with_new_text(out, docs.columns, text_col, size_col)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
g AS (SELECT k.doc_id, k.line, k.i, f.key IS NOT NULL AND k.doc_id <> f.keeper AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM g GROUP BY doc_id
"""
