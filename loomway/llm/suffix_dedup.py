"""Passage dedup by bucket-pointer refinement of suffixes at sampled positions: every byte of a string of ``width``
bytes that also starts earlier is removed.

1. Any ``width`` bytes have a minimal q-gram (the leftmost of least hash), and equal strings have it at the same place:
   only suffixes around these anchors are sorted, about one position in 37. Their q-grams are the initial buckets.
2. Buckets are sorted by what lies within ``width`` around their anchors. Of equal ones all but the first are covered
   whole; where a bucket falls into several, the first of each stay open. A bucket with one member is final.
3. Open buckets are refined (``refined``): every position around their anchors has the pointer of its q-gram's bucket,
   a number given by sorting; positions are sorted again by their own pointer and the pointer at a later offset, which
   gives pointers for more than twice the depth, and these are reused for the next step, until a bucket holds equal
   strings of ``width``. Positions alone in a bucket take no further part. Members of a last bucket are compared byte by
   byte with its first; all but the first are covered.
4. A bucket of more than ``GROUP_ROWS`` is refined over all tasks first: it is dealt into buckets of the bytes that the
   nearer and the farther half of its windows share, again and again until they are small or hold equal strings.
   q-grams that fill more than a thousandth of a sample are dealt by their surroundings from the start.
5. Covered intervals go to their documents.

Bucket identifiers that travel between tasks are hashes. Those of step 1 and 4 only bring together what may be equal;
step 2 takes surroundings as equal that agree in 64 + 64 + 32 independent bits.

Earlier means: smaller id, or the same id and an earlier start. Defined results: a null text is empty; null ids come
last; of rows that repeat an id, those with the same text have one result, others are ordered by a hash of their text;
texts shorter than ``width`` lose nothing; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import materialize, table
from .bytesvec import OTHER, U, mix, prefix, sliced, stretch
from .common import small

WIDTH, GRAM = 100, 28
#: Starts of windows that have a given anchor, and the bytes around an anchor that these windows cover.
STARTS = WIDTH - GRAM + 1
BACK, SPAN = WIDTH - GRAM, 2 * WIDTH - GRAM
#: Members of a bucket that one task refines by itself.
GROUP_ROWS = 2_000
#: Documents, about, whose anchors tell which q-grams are very frequent; that only decides how rows are dealt.
SAMPLE_DOCS, HOT_SHARE, LEAST_HOT = 2000, 1000, 20
LAST = (1 << 63) - 1


def find_anchors(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, place in ``data``, bucket and two identifiers of the surroundings of every anchor, and where these begin and end."""
    if len(data) < WIDTH:
        return (np.zeros(0, np.int64),) * 7
    sums = prefix(data)
    at = np.arange(len(data) - GRAM + 1)
    gram = stretch(sums, at, at + GRAM)
    least = (gram & U(0xFFFFFFFF00000000)) | at.astype(U)
    step = 1
    while 2 * step <= STARTS:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if STARTS > step:
        least = np.minimum(least[: step - STARTS], least[STARTS - step :])
    inside = np.zeros(len(data) + 1, np.int32)
    long = np.diff(rows) >= WIDTH
    np.add.at(inside, rows[:-1][long], 1)
    np.add.at(inside, rows[1:][long] - WIDTH + 1, -1)
    place = (least[np.cumsum(inside)[: len(least)] > 0] & U(0xFFFFFFFF)).astype(np.int64)
    place = place[np.concatenate(([True], place[1:] != place[:-1]))] if len(place) else place
    row = np.searchsorted(rows, place, "right") - 1
    lo, hi = np.maximum(rows[row], place - (WIDTH - GRAM)), np.minimum(rows[row + 1], place + WIDTH)
    around = mix(stretch(sums, lo, hi) + (place - lo).astype(U) * U(0xD1342543DE82EF95))
    also = stretch(prefix(data, OTHER), lo, hi) >> U(33)
    return row, place, gram[place].astype(np.int64), around.astype(np.int64), also.astype(np.int64), lo, hi


ANCHOR = ["h", "c", "id", "th", "d", "pos", "lo", "hi"]
ANCHOR_KIND = "h long, c long, id long, th long, d int, pos int, lo int, hi int"


def _anchor_rows(*cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 4 else pa.int32()) for i, c in enumerate(cols)], ANCHOR)


def repeated(keys: tuple[np.ndarray, ...], who: tuple[np.ndarray, ...]) -> np.ndarray:
    """Of rows sorted by ``keys`` and then ``who``: those that are not the same as the first with their keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    of = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    again = np.zeros(len(new), bool)
    for w in who:
        again |= w[of] != w
    return again


def _anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of each batch. Those that repeat one of the batch are decided here: they become covered intervals (``pos``
    is -1) with a bucket drawn at random, so that what is repeated very often does not meet in one task."""
    for b in batches:
        found: list[list] = [[] for _ in range(9)]
        ids, th = (b.column(i).to_numpy() for i in (0, 1))
        for lo, _, data, rows in sliced(b.column(2)):
            row, place, gram, around, also, a, z = find_anchors(data, rows)
            at = rows[row]
            for col, v in zip(found, (gram, around, ids[lo + row], th[lo + row], also, place - at, a - at, z - at, row + lo)):
                col.append(v)
        if not found[0]:
            continue
        h, c, i, t, d, pos, a, z, row = (np.concatenate(x) for x in found)
        order = np.lexsort((t, pos, i, d, c, h))
        h, c, i, t, d, pos, a, z, row = (x[order] for x in (h, c, i, t, d, pos, a, z, row))
        again = repeated((h, c, d), (i, t, pos))
        first = ~again
        yield _anchor_rows(h[first], c[first], i[first], t[first], d[first], pos[first], a[first], z[first])
        g = np.flatnonzero(again)
        if len(g):
            g = g[np.lexsort((a[g], row[g]))]
            r, lo, hi = row[g], a[g].astype(np.int64), z[g].astype(np.int64)
            reach = np.maximum.accumulate(hi + (r << 40)) - (r << 40)  # of the same row, since rows ascend
            starts = np.ones(len(g), bool)
            starts[1:] = (r[1:] != r[:-1]) | (lo[1:] > reach[:-1])
            s = np.flatnonzero(starts)
            e = np.append(s[1:], len(g)) - 1
            k = g[s]
            spread = mix(i[k].astype(U) * U(0x9E3779B97F4A7C15) + lo[s].astype(U)).astype(np.int64)
            none = np.zeros(len(k), np.int64)
            yield _anchor_rows(spread, none, i[k], t[k], none, none - 1, lo[s], reach[e])


OUT = ["id", "th", "lo", "hi", "h"]


def _made(*cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))], OUT)


def _refine(batches: Iterable[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of a partition sorted by bucket, surroundings, id and place: covered intervals, and open anchors (``hi`` is -1).
    hot: buckets whose classes may lie in several partitions; the first of each class stays open there."""
    lead = None  # h, c, d, id, th, pos of the class at hand
    alone: list = []  # the first of the bucket at hand, while it has no second class
    for b in batches:
        h, c, ids, th, d, pos, lo, hi = (x.to_numpy() for x in b.columns)
        done = pos < 0
        if done.any():
            yield _made(ids[done], th[done], lo[done], hi[done], np.zeros(int(done.sum()), np.int64))
            h, c, ids, th, d, pos, lo, hi = (x[~done] for x in (h, c, ids, th, d, pos, lo, hi))
        if not len(h):
            continue
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])
        new[0] = lead is None or (h[0], c[0], d[0]) != lead[:3]
        of = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
        first = [np.where(of < 0, lead[3 + i] if lead else 0, x[of]) for i, x in enumerate((ids, th, pos))]
        again = ~new & ((first[0] != ids) | (first[1] != th) | (first[2] != pos))
        yield _made(ids[again], th[again], lo[again], hi[again], np.zeros(int(again.sum()), np.int64))
        f = np.flatnonzero(new)
        if len(f):
            same = lead is not None and h[f[0]] == lead[0]
            if same and alone:
                yield _made(*([x] for x in alone))
            if not same or alone:
                alone = []
            opens = np.isin(h[f], hot) if len(hot) else np.zeros(len(f), bool)
            near = h[f[1:]] == h[f[:-1]]
            opens[1:] |= near
            opens[:-1] |= near
            opens[0] |= same
            g = f[opens]
            yield _made(ids[g], th[g], pos[g], np.full(len(g), -1), h[g])
            z = f[-1]
            alone = [] if opens[-1] else [ids[z], th[z], pos[z], -1, h[z]]
            lead = (h[z], c[z], d[z], ids[z], th[z], pos[z])


def _surroundings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around each open anchor."""
    for b in batches:
        rows: list[list] = [[], [], [], [], [], []]
        for i, th, found, text in zip(*(c.to_pylist() for c in b.columns)):
            data = text.encode()
            for x in found:
                p = x["lo"]
                lo = max(0, p - (WIDTH - GRAM))
                for col, v in zip(rows, (x["h"], i, th, p, p - lo, data[lo : p + WIDTH])):
                    col.append(v)
            if len(rows[0]) > 10_000:
                yield _around(rows)
                rows = [[], [], [], [], [], []]
        yield _around(rows)


def _around(rows: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["h", "id", "th", "pos", "left", "bytes"])


def laid_out(left: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts as rows of ``SPAN`` bytes with their anchors below one another, and where each begins and ends."""
    size = np.array([len(t) for t in texts], np.int64)
    data = np.zeros((len(texts), SPAN), np.uint8)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    at = np.repeat(np.arange(len(texts)) * SPAN + BACK - left - (np.cumsum(size) - size), size) + np.arange(len(flat))
    data.reshape(-1)[at] = flat
    return data, BACK - left, BACK - left + size


def pointers(key: np.ndarray) -> np.ndarray:
    """The bucket of each key, numbered by its place when all are sorted; -1 where it is alone."""
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(key)))
    out = np.empty(len(key), np.int64)
    out[order] = np.repeat(np.where(size > 1, begin, -1), size)
    return out


def refined(h: np.ndarray, left: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows ``r``, starts ``p`` of windows in ``SPAN`` and rows ``f``, all below ``r``: the window of ``r`` is that of ``f``."""
    data, begin, end = laid_out(left, texts)
    sums = prefix(data.reshape(-1))
    p = np.arange(SPAN - GRAM + 1)
    at = np.flatnonzero(((p >= begin[:, None]) & (p + GRAM <= end[:, None])).reshape(-1))
    row, p = np.divmod(at, len(p))
    place = row * SPAN + p
    # buckets of q-grams, apart for each anchor's bucket and each distance from the anchor
    bucket = np.full(data.size, -1, np.int64)
    bucket[place] = pointers(mix(stretch(sums, place, place + GRAM) + h[row].astype(U) * U(0x165667B19E3779F9) + p.astype(U) * U(0xD1342543DE82EF95)))
    del row, p, at
    depth = GRAM
    while depth < WIDTH:
        later = min(depth, WIDTH - depth)
        place = place[bucket[place] >= 0]
        place = place[place % SPAN + later + depth <= SPAN]
        both = bucket[place + later]
        place, both = place[both >= 0], both[both >= 0]
        new = pointers((bucket[place] << 32) | both)
        bucket[:] = -1
        bucket[place] = new
        depth += later
    place = place[bucket[place] >= 0]
    place = place[np.argsort(bucket[place], kind="stable")]  # within a bucket by row
    of = bucket[place]
    new = np.ones(len(of), bool)
    new[1:] = of[1:] != of[:-1]
    row, p = np.divmod(place, SPAN)
    first = row[np.maximum.accumulate(np.where(new, np.arange(len(of)), 0))]
    same = compared(data, row, p, first)
    if not same.all():  # q-grams that only share their hash: such buckets are told apart by their bytes
        for b in np.unique(of[~same]).tolist():
            seen: dict[bytes, int] = {}
            for k in np.flatnonzero(of == b).tolist():
                first[k] = seen.setdefault(data[row[k], p[k] : p[k] + WIDTH].tobytes(), int(row[k]))
    hit = first < row
    return row[hit], p[hit], first[hit]


def compared(data: np.ndarray, row: np.ndarray, p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether the windows at ``p`` of two rows are the same byte for byte."""
    out = np.ones(len(row), bool)
    pair, back = np.unique(row * len(data) + first, return_inverse=True)
    order = np.argsort(back, kind="stable")
    for lo in range(0, len(pair), 20_000):
        a, b = np.divmod(pair[lo : lo + 20_000], len(data))
        equal = np.zeros((len(a), SPAN + 1), np.int16)
        np.cumsum(data[a] == data[b], axis=1, out=equal[:, 1:])
        k = order[np.searchsorted(back[order], lo) : np.searchsorted(back[order], lo + len(a))]
        out[k] = equal[back[k] - lo, p[k] + WIDTH] - equal[back[k] - lo, p[k]] == WIDTH
    return out


def _cover(h: np.ndarray, ids: np.ndarray, th: np.ndarray, pos: np.ndarray, left: np.ndarray, texts: list[bytes]) -> pa.RecordBatch:
    order = np.lexsort((h, th, pos, ids))
    keep = np.ones(len(order), bool)
    for k in (h, ids, th, pos):  # the same anchor once only
        keep[1:] &= k[order][1:] == k[order][:-1]
    keep[1:] = ~keep[1:]
    order = order[keep]
    h, ids, th, pos, left = (x[order] for x in (h, ids, th, pos, left))
    row, p, _ = refined(h, left, [texts[i] for i in order.tolist()])
    first, last = np.full(len(order), SPAN, np.int64), np.full(len(order), -1, np.int64)
    np.minimum.at(first, row, p)
    np.maximum.at(last, row, p)
    at = np.flatnonzero(last >= 0)  # windows of one anchor overlap, so what they cover is one interval
    return _made(ids[at], th[at], pos[at] + first[at] - BACK, pos[at] + last[at] + WIDTH - BACK, np.zeros(len(at), np.int64))


def _open(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the open anchors of a partition sorted by bucket, whole buckets at a time."""
    held: list[pa.RecordBatch] = []

    def out(rows: pa.Table) -> pa.RecordBatch:
        c = [rows.column(i).to_numpy() for i in range(5)]
        return _cover(*c, rows.column(5).to_pylist())

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(x.num_rows for x in held) >= GROUP_ROWS:
            rows = pa.Table.from_batches(held).combine_chunks()
            h = rows.column(0).to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            if cut:
                yield out(rows.slice(0, cut))
                held = rows.slice(cut).combine_chunks().to_batches()
    if held:
        yield out(pa.Table.from_batches(held).combine_chunks())


PART = ["id", "th", "lo", "hi", "h", "left", "bytes", "near", "far"]
PART_KIND = "id long, th long, lo int, hi int, h long, left int, bytes binary, near int, far int"


def _dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two buckets for each open one: the anchor is ``near`` to ``far`` bytes after the start of its windows, and each half
    of them goes to the bucket of the bytes that all its windows share. What repeats one of the batch in all bytes of
    its windows is covered; of the others ``hi`` is -1 and ``lo`` the anchor."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32())
    for b in batches:
        h, ids, th, pos, left = (b.column(i).to_numpy().astype(np.int64) for i in range(5))
        texts, near, far = b.column(5).to_pylist(), b.column(6).to_numpy().astype(np.int64), b.column(7).to_numpy().astype(np.int64)
        if not len(h):
            continue
        data, begin, end = laid_out(left, texts)
        sums, other = prefix(data.reshape(-1)), prefix(data.reshape(-1), OTHER)
        middle = (near + far) // 2
        halves: list[list] = [[] for _ in range(9)]
        for lo, hi in ((near, middle), (middle + 1, far)):
            # starts of windows that the text has, within this half
            a, z = np.maximum(lo, WIDTH - (end - BACK)), np.minimum(hi, BACK - begin)
            k = np.flatnonzero(a <= z)
            base = k * SPAN + BACK
            new = mix(stretch(sums, base - lo[k], base + WIDTH - hi[k]) + h[k].astype(U) * U(0x165667B19E3779F9) + lo[k].astype(U) * U(0xD1342543DE82EF95))
            extent = (z[k] * WIDTH + a[k]).astype(U)
            c = mix(stretch(sums, base - z[k], base + WIDTH - a[k]) + extent)
            d = stretch(other, base - z[k], base + WIDTH - a[k])
            for col, v in zip(halves, (k, lo[k], hi[k], a[k], z[k], new.astype(np.int64), c, d, ids[k])):
                col.append(v)
        k, lo, hi, a, z, new, c, d, i = (np.concatenate(x) for x in halves)
        order = np.lexsort((th[k], pos[k], i, d, c, new))
        k, lo, hi, a, z, new, c, d, i = (x[order] for x in (k, lo, hi, a, z, new, c, d, i))
        again = repeated((new, c, d), (i, th[k], pos[k]))
        g, f = np.flatnonzero(again), np.flatnonzero(~again)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((i[g], th[k[g]], pos[k[g]] - z[g], pos[k[g]] - a[g] + WIDTH), kinds)] + [pa.nulls(len(g), t) for t in kinds[4:]], PART)
        own = [texts[r][left[r] - y : left[r] + WIDTH - x] for r, x, y in zip(k[f].tolist(), a[f].tolist(), z[f].tolist())]
        cols = (i[f], th[k[f]], pos[k[f]], np.full(len(f), -1), new[f], z[f], own, lo[f], hi[f])
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)], PART)


OPEN = ["h", "id", "th", "pos", "left", "bytes"]


def _deal_large(wide: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Covered intervals of large buckets, and buckets that are small enough for one task."""
    covered, few, wide = [], [], wide.select(*OPEN, F.lit(0).alias("near"), F.lit(STARTS - 1).alias("far"))
    while True:
        parts = materialize(wide.mapInArrow(_dealt, PART_KIND))
        covered.append(parts.filter("hi >= 0").select("id", "th", "lo", "hi"))
        live = parts.filter("hi < 0").withColumnRenamed("lo", "pos")
        large = small(materialize(live.groupBy("h").count().filter(F.col("count") > GROUP_ROWS).select(F.col("h").alias("large"))))
        few.append(live.join(large, F.col("h") == F.col("large"), "left_anti").select(*OPEN))
        live = live.join(large, F.col("h") == F.col("large"), "left_semi")
        # a bucket of one start of windows holds whole windows
        ends = live.filter("near = far").select("id", "th", (F.col("pos") - F.col("left")).alias("lo"), "bytes")
        firsts = small(materialize(ends.groupBy(F.col("bytes").alias("b")).agg(F.min(F.struct("id", "lo", "th")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")))
        covered.append(ends.join(firsts, F.col("bytes") == F.col("b")).filter(F.struct("id", "lo", "th") > F.col("first")).select("id", "th", "lo", (F.col("lo") + WIDTH).alias("hi")))
        wide = live.filter("near < far").select(*OPEN, "near", "far")
        if not wide.take(1):
            return covered, few


def _removed(batches: Iterable[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[list] = [[], [], [], [], []]
        for i, text, found in zip(*(c.to_pylist() for c in b.columns)):
            data = (text or "").encode()
            kept, spans, end, gone = [], 0, -1, 0
            for x in sorted((x["lo"], x["hi"]) for x in found or ()):
                if x[0] > end:
                    kept.append(data[max(end, 0) : x[0]])
                    spans += 1
                    gone += x[1] - x[0]
                elif x[1] > end:
                    gone += x[1] - end
                end = max(end, x[1])
            kept.append(data[max(end, 0) :])
            left = b"".join(kept)
            for col, v in zip(rows, (i, len(data), gone, spans, left if with_text else hashlib.sha256(left).hexdigest())):
                col.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary() if with_text else pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept" if with_text else "kept_sha256"])


def hot_grams(texts: DataFrame, total: int) -> list[int]:
    """q-grams with more than their share of a sample's anchors: ``HOT_SHARE`` of them at most, by that very share."""
    drawn = texts.filter(F.pmod(F.xxhash64("key", "th"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE_DOCS / max(1, total))))
    counts = materialize(drawn.mapInArrow(_anchors, ANCHOR_KIND).filter("pos >= 0").groupBy("h").count())
    n = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    return [r["h"] for r in counts.filter((F.col("count") >= LEAST_HOT) & (F.col("count") * HOT_SHARE > n)).select("h").collect()]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans`` with the remaining bytes as ``kept``, or only their ``kept_sha256``."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total, single = slim.agg(F.count("*"), F.count_distinct("id")).first()
    # ids alone name the rows where none is repeated or null
    th = F.lit(0).cast("long") if total == single else F.xxhash64("text")
    slim = slim.select(F.coalesce("id", F.lit(LAST)).alias("key"), "id", th.alias("th"), "text")
    texts = slim.select("key", "th", F.coalesce("text", F.lit("")))
    hot = hot_grams(texts, total)
    anchors = texts.mapInArrow(_anchors, ANCHOR_KIND)
    deal = F.when(F.col("h").isin(hot), F.xxhash64("h", "c")).otherwise(F.col("h")) if hot else F.col("h")
    buckets = anchors.repartition(deal).sortWithinPartitions("h", "c", "d", "id", "pos", "th")
    kind, few = "id long, th long, lo int, hi int, h long", np.array(sorted(hot), np.int64)
    found = materialize(buckets.mapInArrow(lambda it: _refine(it, few), kind))
    covered = [found.filter("hi >= 0").drop("h")]
    opened = found.filter("hi < 0").groupBy("id", "th").agg(F.collect_list(F.struct("h", "lo")).alias("found"))
    around = opened.join(slim.drop("id").withColumnsRenamed({"key": "k", "th": "t"}), (F.col("id") == F.col("k")) & (F.col("th") == F.col("t"))).select("id", "th", "found", "text")
    around = around.mapInArrow(_surroundings, "h long, id long, th long, pos int, left int, bytes binary")
    large = materialize(found.filter("hi < 0").groupBy("h").count().filter(F.col("count") > GROUP_ROWS).select(F.col("h").alias("large")))
    if large.take(1):
        around, large = materialize(around), small(large)
        more, parts = _deal_large(around.join(large, F.col("h") == F.col("large"), "left_semi"))
        covered += more
        around = reduce(DataFrame.unionByName, [around.join(large, F.col("h") == F.col("large"), "left_anti"), *parts])
    covered.append(materialize(around.repartition("h").sortWithinPartitions("h").mapInArrow(_open, kind)).drop("h"))
    spans = reduce(DataFrame.unionByName, covered).groupBy("id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("found"))
    spans = spans.withColumnsRenamed({"id": "k", "th": "t"})
    out = slim.join(spans, (F.col("key") == F.col("k")) & (F.col("th") == F.col("t")), "left").select("id", "text", "found")
    return out.mapInArrow(lambda it: _removed(it, with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, " + ("kept binary" if with_text else "kept_sha256 string"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
