"""Near duplicates by an LSH forest over MinHash signatures, every link confirmed on full shingle sets.

1. Texts become sets of hashed word shingles; equal sets are one set from here on.
2. Each set has ``TREES`` labels of ``DEPTH`` minhashes. The labels are sorted, over range partitions, in each tree;
   neighbours whose common prefix is as long as their region asks for are candidates. A region of equal prefixes
   asks for one more minhash as long as it holds more than ``REGION`` sets.
3. Connected candidates form a bundle; bundles hold every pair that could be linked, up to the chance that a pair
   shares no prefix in any tree. Within bundles all pairs are compared in full, unless already connected: bundles are
   cut into blocks of bounded size, each block with the bundle's pivots in one task, and what is then not in the
   bundle's largest component meets all of its blocks. No pair is capped or sampled away.
4. Confirmed links give the components.

At depth 4 a pair of similarity 0.8 shares no prefix with probability 7e-10, at depth 6 (regions of over ``REGION``) 5e-6.

Defined results: a null text or one without words has an empty set and is linked with nothing; a null id is never the
smallest, its rows have the component of their group, null if no id is there; rows that repeat an id are the same
document and are all kept or all dropped; an empty table gives an empty result; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import materialize, table
from ..operators.components import connected_components
from .bytesvec import LOWER, U, mix, prefix, sliced, stretch, words
from .common import flag_perhaps, modest_batches, small

TREES, DEPTH, BASE, REGION = 40, 6, 4, 50
BLOCK, PIVOTS = 256, 16
#: Sets that a task remembers having labelled; more only means labels that are made again.
REMEMBERED = 500_000
_rng = np.random.default_rng(20240607)
_MULTIPLIERS = _rng.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) | U(1)
_ADDENDS = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text its set of hashed shingles, sorted; with fewer words than ``width``, that of all its words."""
    for lo, hi, data, rows in sliced(column):
        data = LOWER[data]
        start, end = words(data, rows)
        h = stretch(prefix(data), start, end)
        first = np.searchsorted(start, rows)
        run = np.zeros(len(h), U)
        for k in range(width):
            run[: len(h) - k] = mix(run[: len(h) - k] * U(0x9FB21C651E98DF25) + h[k:])
        for i in range(hi - lo):
            a, b = first[i], first[i + 1]
            if b - a >= width:
                yield np.unique(run[a : b - width + 1])
            elif b > a:
                short = np.zeros(1, U)
                for k in range(a, b):
                    short = mix(short * U(0x9FB21C651E98DF25) + h[k : k + 1])
                yield short ^ U(b - a)
            else:
                yield run[:0]


def _print(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    if not len(s):
        return 0, 0
    a, b = mix(s + U(len(s))), mix(s ^ U(0xA0761D6478BD642F))
    return int(mix(a.sum(keepdims=True, dtype=U))[0].astype(np.int64)), int(mix(b.sum(keepdims=True, dtype=U) + U(1))[0].astype(np.int64))


def _prints(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Adds the size and print of each text's set, and the labels where a partition has the set for the first time."""
    seen = set()
    for b in batches:
        n, k1, k2, labels = [], [], [], []
        for s in shingle_sets(b.column(b.num_columns - 1), width):
            n.append(len(s))
            a, c = _print(s)
            k1.append(a)
            k2.append(c)
            if len(s) and (a, c) not in seen:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add((a, c))
                least = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, U)
                for lo in range(0, len(s), 512):
                    np.minimum(least, (s[lo : lo + 512, None] * _MULTIPLIERS + _ADDENDS).min(0), out=least)
                labels.append((mix(least) >> U(32)).astype("<u4").tobytes())
            else:
                labels.append(None)
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(labels, pa.binary())], [*b.schema.names[:-1], "n", "k1", "k2", "label"])


def _trees(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per tree: the prefix of ``BASE`` minhashes as a number, the rest as another, the set."""
    for b in batches:
        lab = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u4").reshape(-1, TREES, DEPTH).astype(U)
        head = np.broadcast_to(np.arange(1, TREES + 1, dtype=U), lab.shape[:2])
        for k in range(BASE):
            head = mix(head * U(0x9FB21C651E98DF25) + lab[:, :, k])
        rest = (lab[:, :, BASE] << U(32)) | lab[:, :, BASE + 1]
        yield pa.RecordBatch.from_arrays([pa.array(head.ravel().astype(np.int64)), pa.array(rest.ravel().astype(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), TREES))], ["head", "rest", "k1"])


def _runs(key: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1)) if len(key) else np.zeros(0, np.int64)


def _neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of one sorted partition: each set with the first of its region. The first and last row go out as well, for
    regions that reach into the next partition."""
    held: list[np.ndarray] = []
    first = last = None

    def out(rows: np.ndarray) -> pa.RecordBatch:
        head, rest, k1 = rows.T
        src, dst = [], []
        a = _runs(head)
        size = np.diff(np.append(a, len(head)))
        region = np.repeat(np.arange(len(a)), size)
        wide = size[region] > REGION
        for bits in (32, 0):  # one more minhash, then two
            key = np.where(wide, (rest.view(U) >> U(bits)).astype(np.int64), 0)
            b = np.concatenate(([True], (region[1:] != region[:-1]) | (key[1:] != key[:-1])))
            size = np.diff(np.append(np.flatnonzero(b), len(head)))
            region = np.cumsum(b) - 1
            wide &= size[region] > REGION
        heads = np.flatnonzero(np.concatenate(([True], region[1:] != region[:-1])))
        to = k1[heads][region]
        pairs = np.unique(np.stack([k1, to], 1)[k1 != to], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.int64()), pa.nulls(len(pairs), pa.int32())], ["src", "dst", "head", "part"])

    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for b in batches:
        rows = np.stack([b.column(i).to_numpy() for i in range(3)], 1)
        if not len(rows):
            continue
        first = rows[0] if first is None else first
        last = rows[-1]
        held.append(rows)
        if sum(map(len, held)) >= 200_000:
            rows = np.concatenate(held)
            cut = int(np.flatnonzero(rows[:, 0] == rows[-1, 0])[0])
            # a region that fills all that is held goes out in pieces that share a row
            yield out(rows[: cut or len(rows)])
            held = [rows[cut:] if cut else rows[-1:]]
    if held:
        yield out(np.concatenate(held))
        ends = [pa.array([int(x[2]) for x in (first, last)]), pa.nulls(2, pa.int64()), pa.array([int(x[0]) for x in (first, last)]), pa.array([2 * part, 2 * part + 1], pa.int32())]
        yield pa.RecordBatch.from_arrays(ends, ["src", "dst", "head", "part"])


def candidates(prints: DataFrame) -> DataFrame:
    """``src, dst`` (k1 of sets): neighbours in some tree."""
    spark = prints.sparkSession
    rows = materialize(prints.select("k1", "label").mapInArrow(_trees, "head long, rest long, k1 long"))
    ordered = rows.repartitionByRange("head", "rest", "k1").sortWithinPartitions("head", "rest", "k1")
    found = materialize(ordered.mapInArrow(_neighbours, "src long, dst long, head long, part int"))
    ends = sorted((r["part"], r["head"], r["src"]) for r in found.filter("dst is null").collect())  # two rows per partition
    over = [(a[2], b[2]) for a, b in zip(ends[1::2], ends[2::2]) if a[1] == b[1] and a[2] != b[2]]
    return found.filter("dst is not null").select("src", "dst").unionByName(spark.createDataFrame(over, "src long, dst long"))


def linked(sets: list[np.ndarray], label: np.ndarray, percent: int) -> np.ndarray:
    """Component labels after joining all pairs of sets of at least that similarity whose labels differ."""
    n = np.array([len(s) for s in sets], np.int64)
    who = np.repeat(np.arange(len(sets)), n)
    _, col, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = df[col] > 1
    who, col = who[keep], np.unique(col[keep], return_inverse=True)[1]
    m, v = len(sets), int(col.max()) + 1 if len(col) else 0
    both = np.zeros((m, m), np.float32)
    order = np.argsort(col, kind="stable")
    who, col = who[order], col[order]
    step = max(64, (4 << 20) // m)
    for lo in range(0, v, step):
        a, b = np.searchsorted(col, [lo, lo + step])
        dense = np.zeros((m, min(step, v - lo)), np.float32)
        dense[who[a:b], col[a:b] - lo] = 1
        both += dense @ dense.T
    label = label.copy()
    i, j = np.nonzero(np.triu(100 * both >= percent * (n[:, None] + n[None, :] - both), 1))
    for a, b in zip(i.tolist(), j.tolist()):
        if label[a] != label[b]:
            label[label == label[b]] = label[a]
    return label


def _confirm(batches: Iterable[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links of the groups ``(bundle, block)`` that lie one after the other: ``k1, k2`` of each set and of one in its component."""
    held: list[tuple] = []
    now = None

    def out() -> pa.RecordBatch:
        seen: dict[tuple, np.ndarray] = {}
        known: dict[tuple, int] = {}
        texts = pa.array([h[3] for h in held], pa.large_binary())
        for (_, key, comp, _), s in zip(held, shingle_sets(texts, width)):
            if len(s) and _print(s) == key and key not in seen:  # else it is another text of the same id
                seen[key], known[key] = s, comp
        keys = list(seen)
        if not keys:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 4, ["a1", "a2", "b1", "b2"])
        names: dict = {}
        start = np.array([names.setdefault(k if known[k] is None else known[k], len(names)) for k in keys])
        label = linked(list(seen.values()), start, percent)
        at = {x: keys[i] for i, x in reversed(list(enumerate(label.tolist())))}
        pairs = [(*k, *at[x]) for k, x in zip(keys, label.tolist()) if at[x] != k]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in range(4)], ["a1", "a2", "b1", "b2"])

    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(5)] + [b.column(5).cast(pa.large_binary()).to_pylist()]
        for bundle, block, k1, k2, comp, text in zip(*cols):
            if (bundle, block) != now and held:
                if len(held) > 1:
                    yield out()
                held = []
            now = (bundle, block)
            held.append((now, (k1, k2), comp, text))
    if len(held) > 1:
        yield out()


def _who(row_id: Column, text: Column) -> Column:
    """What tells the rows of one id, or one text without an id, from others."""
    return F.struct(row_id.isNull().alias("none"), F.coalesce(row_id, F.xxhash64(text)).alias("id"))


def _compare(groups: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``groups``: bundle, block, k1, k2, who, comp. Texts go to the groups they are in; nothing else is moved."""
    groups = materialize(groups)
    own = _who(F.col("row.id"), F.col("row.text"))
    texts = flag_perhaps(docs, _who(F.col("id"), F.col("text")), groups.select("who").distinct()).filter("perhaps").select(own.alias("w"), "row.text")
    rows = texts.join(small(groups), F.col("who") == F.col("w")).select("bundle", "block", "k1", "k2", "comp", "text")
    rows = rows.repartition("bundle", "block").sortWithinPartitions("bundle", "block")
    return materialize(rows.mapInArrow(lambda it: _confirm(it, width, percent), "a1 long, a2 long, b1 long, b2 long"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per input row."""
    modest_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    slim = slim.select("id", _who(F.col("id"), F.col("text")).alias("who"), "text")
    rows = materialize(slim.mapInArrow(lambda it: _prints(it, width), "id long, who struct<none:boolean,id:bigint>, n long, k1 long, k2 long, label binary"))
    # a set's least id, and its text by that id or, where all are null, by itself
    sets = materialize(rows.filter("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.min("who").alias("who")))
    bundles = materialize(connected_components(candidates(rows.filter("label is not null"))).select(F.col("node").alias("k1"), F.col("component").alias("bundle")))
    sized = materialize(bundles.groupBy("bundle").agg(F.count("*").alias("size")))
    every = materialize(sets.join(small(bundles), "k1").join(small(sized), "bundle").select("bundle", "size", "k1", "k2", "who"))
    members = materialize(every.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("at", F.pmod(F.xxhash64("k1", "k2"), F.lit(1 << 40))))
    pivot = (F.col("blocks") > 1) & (F.col("at") < F.lit(float(1 << 40)) * PIVOTS / F.col("size"))
    own = F.pmod("at", F.col("blocks")).cast("int")
    places = F.when(pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    groups = members.select("bundle", F.explode(places).alias("block"), "k1", "k2", "who", F.lit(None).cast("long").alias("comp"))
    links = _compare(groups, slim, width, percent)
    # in a bundle of one block the links are stars already
    wide = members.filter("blocks > 1")
    roots = links.select(F.col("a1").alias("k1"), F.col("a2").alias("k2"), F.col("b1").alias("comp"), F.col("b2").alias("comp_2"))
    if wide.take(1):
        keys = small(materialize(wide.select(F.col("k1").alias("w1"), F.col("k2").alias("w2"))))
        of_wide = (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2"))
        mine = roots.join(keys, of_wide, "left_semi")
        comp = _resolve(mine)
        # what is not in the largest component of such a bundle meets every block
        wide = wide.join(comp, ["k1", "k2"], "left").withColumn("comp", F.coalesce("comp", "k1"))
        per = wide.groupBy("bundle", "comp").agg(F.count("*").alias("n"))
        main = per.groupBy("bundle").agg(F.max(F.struct("n", "comp"))["comp"].alias("main"), (F.sum("n") - F.max("n")).alias("rest"))
        wide = materialize(wide.join(main, "bundle").filter("rest > 0").withColumn("outs", F.ceil(F.col("rest") / BLOCK).cast("int")))
        u = F.when(F.col("comp") != F.col("main"), F.pmod(F.shiftright("at", 20), F.col("outs")).cast("int"))
        meet = wide.select("*", u.alias("u"), own.alias("b"))
        as_member = meet.select("bundle", F.explode(F.sequence(F.lit(0), F.col("outs") - 1)).alias("x"), F.col("b").alias("y"), "k1", "k2", "who", "comp")
        as_rest = meet.filter("u is not null").select("bundle", F.col("u").alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"), "k1", "k2", "who", "comp")
        both = as_member.unionByName(as_rest).distinct().select("bundle", (F.col("x").cast("long") * (1 << 31) + F.col("y")).alias("block"), "k1", "k2", "who", "comp")
        more = _compare(both, slim, width, percent)
        if more.take(1):
            comp = _resolve(mine.unionByName(more.select(F.col("a1").alias("k1"), F.col("a2").alias("k2"), F.col("b1").alias("comp"), F.col("b2").alias("comp_2"))))
        roots = roots.join(keys, of_wide, "left_anti").unionByName(comp)
    # a root stands for itself
    roots = materialize(roots.unionByName(roots.select(F.col("comp").alias("k1"), F.col("comp_2").alias("k2"), "comp", "comp_2")).distinct())
    groups = sets.join(small(roots), ["k1", "k2"]).select("k1", "k2", "comp", "comp_2", "id")
    least = groups.groupBy("comp", "comp_2").agg(F.min("id").alias("component"))
    found = materialize(roots.join(least, ["comp", "comp_2"]).select("k1", "k2", "component"))
    known = sets.join(small(found.withColumn("in", F.lit(True))), ["k1", "k2"], "left").select("k1", "k2", F.when(F.col("in"), F.col("component")).otherwise(F.col("id")).alias("component"))
    full = rows.drop("label", "who").join(known, ["k1", "k2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return full.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _resolve(roots: DataFrame) -> DataFrame:
    """``k1, k2`` of the linked sets with ``comp, comp_2``, the keys of one set of their component."""
    node = lambda a, b: F.struct(F.col(a).alias("k1"), F.col(b).alias("k2"))
    e = roots.select(node("k1", "k2").alias("src"), node("comp", "comp_2").alias("dst"))
    return materialize(connected_components(e).select("node.k1", "node.k2", F.col("component.k1").alias("comp"), F.col("component.k2").alias("comp_2")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents without near duplicates of one with a smaller id; same columns. An id goes if none of its rows is kept."""
    found = components(docs, id_col=id_col, **options).groupBy("doc_id").agg(F.max("kept").alias("any"))
    gone = materialize(found.filter("not any").select(F.col("doc_id").alias("gone")))
    rows = flag_perhaps(docs, F.col(id_col).cast("long"), gone)
    mine = F.col("row").getField(id_col).cast("long")
    left = rows.filter("perhaps").join(gone, mine.eqNullSafe(F.col("gone")), "left_anti")
    return rows.filter("not perhaps").unionByName(left).select("row.*")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"), width=4)
