"""Best-fit packing of tokenized documents into sequences of a fixed capacity, in bulk-synchronous rounds.

Pieces of more than half the capacity have a sequence each, whose rest is a gap. Then, round by round:

1. Pieces longer than every gap open sequences: the longest of them, as many as their tokens fill.
2. Pieces and gaps are range-sorted by size, a piece before a gap of its size. Where gaps are fewer than pieces, a gap
   of at least twice the longest piece goes in as several.
3. Every task sweeps its range upward: a gap takes the longest piece below it that is still free, the one ranked
   nearest, so that a piece goes to the successor that is left for it. Pieces and gaps that no one in the range took
   are counted per range; from the counts alone (two numbers a task) follows by rank which ranges' pieces meet which
   later ranges' gaps, and these are joined by rank.
4. Gaps are reduced by what they took, and the next round begins, until no piece is left.

The result needs as many sequences as best-fit decreasing, or few more (tests compare both).

Token ids are those of ``tokenizers``. White space that begins a word always begins a token of the vocabulary's pattern,
and so does a mark after a letter; words, with the white space before them, are therefore encoded one by one, the distinct
ones of a batch once. Texts with unusual white space are encoded whole.

Defined results: a null text is empty and has only the end id; each row is a document of its own, whether or not its
id is repeated or null; equal lengths are ranked by a hash of id and piece; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import forget, materialize, table
from .bytesvec import sliced
from .common import modest_batches

CAPACITY, END = 1024, 2
VOCABULARY = "byte_bpe_50k"
#: Words that a worker remembers, at most twice as many, and the bytes of the longest.
WORDS, WORD_BYTES = 150_000, 48
SLICE_BYTES = 1 << 21
BLANKS = frozenset(b"\t\n\r ")
BLANK, LETTER, MARK = np.zeros((3, 256), bool)
BLANK[list(BLANKS)] = True
LETTER[65:91] = LETTER[97:123] = True
MARK[list(b',.;:!?)"')] = True
#: White space, or what may pass for it, beside BLANK; and the bytes it may begin with.
ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")
ODD_BYTE = np.zeros(256, bool)
ODD_BYTE[[0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True


@lru_cache(1)
def encoder(vocabulary: str):
    """The tokenizer, the bytes that each id stands for (their number), and the words seen of late and before."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
    size = np.zeros(whole.get_vocab_size(), np.int64)
    for word, i in whole.get_vocab().items():
        size[i] = len(word)  # one character stands for one byte
    for i, word in whole.get_added_tokens_decoder().items():
        size[i] = len(word.content.encode())
    return whole, size, [{}, {}]


def encode_words(words: list[bytes], vocabulary: str) -> list[bytes]:
    """Ids of each word by itself, as little-endian unsigned 32-bit numbers."""
    whole, size, known = encoder(vocabulary)
    late, before = known
    out = list(map(late.get, words))
    missing = [i for i, ids in enumerate(out) if ids is None]
    run, rest = [], []
    for i in missing:
        w = words[i]
        ids = before.get(w)
        if ids is not None:
            out[i] = late[w] = ids
        # words that begin with white space and end without can be encoded in one go and told apart by their bytes
        elif w[0] in BLANKS and w[-1] not in BLANKS and len(w) <= WORD_BYTES:
            run.append(w)
        else:
            rest.append(w)
    ids = whole.encode_batch_fast([b"".join(run).decode()], add_special_tokens=False)[0].ids
    ends = np.cumsum(np.fromiter(map(len, run), np.int64, len(run)))
    cuts = (4 * np.searchsorted(np.cumsum(size[ids]), ends, "right")).tolist()
    packed = np.array(ids, "<u4").tobytes()
    new = {w: packed[lo:hi] for w, lo, hi in zip(run, [0, *cuts], cuts)}
    new |= {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(rest, whole.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False))}
    for i in missing:
        if out[i] is None:
            out[i] = new[words[i]]
    late.update(new if not rest else {w: x for w, x in new.items() if len(w) <= WORD_BYTES})
    if len(late) > WORDS:
        known[:] = {}, late
    return out


def token_ids(column: pa.Array, vocabulary: str = VOCABULARY) -> Iterator[np.ndarray]:
    """The ids of each text."""
    for lo, hi, data, rows in sliced(column, SLICE_BYTES):
        cut = BLANK[data]
        cut[1:] &= ~cut[:-1]
        cut[1:] |= MARK[data[1:]] & LETTER[data[:-1]]
        cut[rows[:-1][rows[:-1] < len(data)]] = True
        odd = np.searchsorted(rows, np.flatnonzero(ODD_BYTE[data]), "right") - 1
        for r in np.unique(odd).tolist():
            if ODD.search(data[rows[r] : rows[r + 1]].tobytes().decode()):
                cut[rows[r] + 1 : rows[r + 1]] = False
        start = np.flatnonzero(cut)
        bounds = np.append(start, len(data)).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        of = words.indices.to_numpy()
        ids = encode_words(words.dictionary.to_pylist(), vocabulary)
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool = np.frombuffer(b"".join(ids), "<u4")
        first, each = (np.cumsum(n) - n)[of], n[of]
        ends = np.cumsum(each)
        flat = pool[np.repeat(first - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        at = np.concatenate(([0], ends))[np.searchsorted(start, rows)]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            yield flat[a:b]


def _pieces(batches: Iterable[pa.RecordBatch], vocabulary: str, capacity: int, end: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    for b in batches:
        rows: list[list] = [[] for _ in names]
        for doc, ids in zip(b.column(0).to_pylist(), token_ids(b.column(1), vocabulary), strict=True):
            ids = np.append(ids, np.array([end], "<u4"))
            cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
            for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                for col, v in zip(rows, (doc, i, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes()), *([ids[lo:hi].tolist()] * with_ids))):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names)


def nearest_pairs(gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Along pieces (False) and gaps (True): places of the pieces that are taken, of the gaps that take them, of the pieces
    left and of the gaps left. Every gap takes the nearest piece before it that no gap in between took."""
    height = np.cumsum(np.where(gap, -1, 1))
    floor = np.minimum(np.minimum.accumulate(height), 0) if len(gap) else height
    before = np.concatenate(([0], floor[:-1]))
    idle = gap & (floor < before)
    at = np.flatnonzero(~idle)
    level = height[at] + gap[at]
    order = np.argsort(level, kind="stable")  # on each level pieces and gaps alternate
    at, level = at[order], level[order]
    meets = np.zeros(len(at), bool)
    meets[:-1] = ~gap[at[:-1]] & gap[at[1:]] & (level[1:] == level[:-1])
    k = np.flatnonzero(meets)
    left = np.ones(len(gap), bool)
    left[at[k]] = left[at[k + 1]] = False
    return at[k], at[k + 1], np.flatnonzero(left & ~gap), np.flatnonzero(left & gap)


SWEPT = "pid long, length int, sequence_id long, part int, at long"


def _sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a range of pieces and gaps in order: pairs (``part`` is null), and what is left, numbered in order."""
    from pyspark import TaskContext

    part, gaps = TaskContext.get().partitionId(), 0
    free, size = np.zeros(0, np.int64), np.zeros(0, np.int64)  # pieces that no gap took so far

    def out(pid, length, seq, at=None) -> pa.RecordBatch:
        n = len(pid if pid is not None else seq)
        cols = [(pid, pa.int64()), (length, pa.int32()), (seq, pa.int64()), (None if at is None else np.full(n, part), pa.int32()), (at, pa.int64())]
        return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else pa.array(c, k) for c, k in cols], ["pid", "length", "sequence_id", "part", "at"])

    for b in batches:
        n, kind, who = (b.column(b.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("size", "kind", "who"))
        top = min(len(free), int(kind.sum()))  # no more of them can be taken by this batch
        free, held = free[: len(free) - top], free[len(free) - top :]
        size, held_size = size[: len(size) - top], size[len(size) - top :]
        who, n, gap = np.concatenate((held, who)), np.concatenate((held_size, n)), np.concatenate((np.zeros(top, bool), kind > 0))
        piece, by, left, idle = nearest_pairs(gap)
        yield out(who[piece], n[piece], who[by])
        yield out(None, None, who[idle], np.arange(len(idle)) + gaps)
        gaps += len(idle)
        free, size = np.concatenate((free, who[left])), np.concatenate((size, n[left]))
    yield out(free, size, None, np.arange(len(free)))


def across(left: list[tuple[int, int, int]]) -> list[tuple[int, bool, int, int, int, int]]:
    """Which of the left pieces and gaps of the ranges (``part``, pieces, gaps) meet: ``part``, whether gaps, first and end
    of their numbers, and the number of the pair that is ``sign * at + shift``."""
    free: list[list[int]] = []
    out, pairs = [], 0
    for part, pieces, gaps in sorted(left):
        at = 0
        while at < gaps and free:
            who, n = free[-1]
            k = min(n, gaps - at)
            out.append((part, True, at, at + k, 1, pairs - at))
            out.append((who, False, n - k, n, -1, pairs + n - 1))
            at, pairs = at + k, pairs + k
            free[-1][1] -= k
            if not free[-1][1]:
                free.pop()
        if pieces:
            free.append([part, pieces])
    return out


def _match(pieces: DataFrame, gaps: DataFrame) -> DataFrame:
    """One sweep over ``pid, length`` and ``sequence_id, part, gap``: every piece with the sequence that takes it, or null."""
    spark = pieces.sparkSession
    rows = pieces.select(F.col("length").alias("size"), F.lit(0).alias("kind"), F.col("pid").alias("who"), F.lit(0).alias("part"))
    rows = rows.unionByName(gaps.select(F.col("gap").alias("size"), F.lit(1).alias("kind"), F.col("sequence_id").alias("who"), "part"))
    rows = rows.withColumn("h", F.xxhash64("who", "part"))
    swept = materialize(rows.repartitionByRange("size", "kind", "h").sortWithinPartitions("size", "kind", "h").mapInArrow(_sweep, SWEPT))
    out, left = swept.filter("part is null").select("pid", "length", "sequence_id"), swept.filter("part is not null")
    counts = left.groupBy("part").agg(F.count("pid").alias("p"), (F.count("*") - F.count("pid")).alias("g")).collect()  # one row a task
    met = across([tuple(r) for r in counts])
    if met:
        pairs = F.broadcast(spark.createDataFrame(met, "of int, gaps boolean, lo long, hi long, sign int, shift long"))
        named = left.join(pairs, (F.col("part") == F.col("of")) & (F.col("pid").isNull() == F.col("gaps")) & (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")), "left")
        named = named.select("pid", "length", "sequence_id", (F.col("sign") * F.col("at") + F.col("shift")).alias("pair"))
        by = named.filter("pid is null and pair is not null").select("sequence_id", "pair")
        left = named.filter("pid is not null").drop("sequence_id").join(by, "pair", "left")
    out = materialize(out.unionByName(left.filter("pid is not null").select("pid", "length", "sequence_id")))
    forget(swept)
    return out


def _histogram(pieces: DataFrame, gaps: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """How many pieces and gaps there are of each size; as many entries as sizes, which the capacity bounds."""
    sizes = pieces.select(F.lit(0).alias("kind"), F.col("length").alias("size")).unionByName(gaps.select(F.lit(1).alias("kind"), F.col("gap").alias("size")))
    found: tuple[dict[int, int], dict[int, int]] = {}, {}
    for r in sizes.groupBy("kind", "size").count().collect():
        found[r["kind"]][r["size"]] = r["count"]
    return found


def _openers(pieces: DataFrame, counts: dict[int, int], above: int, capacity: int, salt: int) -> tuple[DataFrame, dict[int, int]]:
    """Marks those that open sequences: of the pieces longer than ``above`` the longest, about as many as sequences that
    all of these fill. Also how many of each length that is, about."""
    sizes, opened = sorted((n for n in counts if n > above), reverse=True), {}
    want = -(-sum(n * counts[n] for n in sizes) // capacity)
    for n in sizes:
        opened[n] = min(want, counts[n])
        want -= opened[n]
        if not want:
            break
    rank = F.pmod(F.xxhash64("pid", F.lit(salt)), F.lit(1 << 40))
    last = 1 << 40
    if opened[n] < counts[n]:
        last = pieces.filter(F.col("length") == n).agg(F.percentile_approx(rank, opened[n] / counts[n], 10_000)).first()[0]
    return pieces.withColumn("opens", (F.col("length") > n) | ((F.col("length") == n) & (rank <= last))), opened


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pid, length, sequence_id, round`` for pieces ``pid`` (unique), ``length`` (1 to ``capacity``); a sequence has the
    number of the piece that opened it."""
    own = lambda df, n: df.select("pid", "length", F.col("pid").alias("sequence_id"), F.lit(n).alias("round"))
    rest = lambda df: df.select(F.col("pid").alias("sequence_id"), (F.lit(capacity) - F.col("length")).cast("int").alias("gap"))
    alone = pieces.filter(2 * F.col("length") > capacity)
    placed, round_ = [own(alone, 0)], 0
    left, gaps = pieces.filter(2 * F.col("length") <= capacity), rest(alone)
    while True:
        counts, have = _histogram(left, gaps)
        if not counts:
            return reduce(DataFrame.unionByName, placed)
        round_ += 1
        have = {g: n for g, n in have.items() if g >= min(counts)}
        gaps = gaps.filter(F.col("gap") >= min(counts))
        if max(counts) > max(have, default=0):
            marked, opened = _openers(left, counts, max(have, default=0), capacity, round_)
            placed.append(own(marked.filter("opens"), round_))
            gaps = gaps.unionByName(rest(marked.filter("opens")))
            left = marked.filter("not opens").select("pid", "length")
            counts = {n: c - opened.get(n, 0) for n, c in counts.items() if c > opened.get(n, 0)}
            if not counts:
                return reduce(DataFrame.unionByName, placed)
            have = have | {-n: c for n, c in opened.items()}  # told apart from gaps that were there
        longest, most = max(counts), -(-sum(counts.values()) // max(1, sum(have.values())))
        parts = F.greatest(F.lit(1), F.least(F.floor(F.col("gap") / longest), F.lit(most))).cast("int")
        split = gaps.withColumn("parts", parts).select("sequence_id", "gap", "parts", F.explode(F.sequence(F.lit(1), F.col("parts"))).alias("part"))
        split = split.select("sequence_id", "part", F.when(F.col("part") < F.col("parts"), longest).otherwise(F.col("gap") - (F.col("parts") - 1) * longest).cast("int").alias("gap"))
        met = _match(left, split)
        took, left = met.filter("sequence_id is not null"), met.filter("sequence_id is null").select("pid", "length")
        placed.append(took.withColumn("round", F.lit(round_)))
        used = took.groupBy(F.col("sequence_id").alias("q")).agg(F.sum("length").alias("used"))
        gaps = materialize(gaps.join(used, F.col("sequence_id") == F.col("q"), "left").select("sequence_id", (F.col("gap") - F.coalesce("used", F.lit(0))).cast("int").alias("gap")).filter("gap > 0"))


def _offsets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Offsets along pieces that lie sequence by sequence."""
    last, end = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        q, n = (b.column(b.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("sequence_id", "length"))
        new = np.ones(len(q), bool)
        new[1:] = q[1:] != q[:-1]
        new[0] = q[0] != last
        before = np.cumsum(n) - n + end
        base = np.where(new, before, 0)
        offset = before - np.maximum.accumulate(base)
        last, end = q[-1], int(offset[-1] + n[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(offset)], [*b.schema.names, "offset"])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """Per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, and its ``ids`` if asked for."""
    modest_batches(docs.sparkSession)
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = materialize(slim.mapInArrow(lambda it: _pieces(it, vocabulary, capacity, end, with_ids), kind).withColumn("pid", F.monotonically_increasing_id()))
    found = assign(pieces.select("pid", F.col("length").cast("int").alias("length")), capacity)
    rows = found.repartition("sequence_id").sortWithinPartitions("sequence_id", "round", "pid")
    places = rows.mapInArrow(_offsets, "pid long, length int, sequence_id long, round int, offset long").select(F.col("pid").alias("p"), "sequence_id", "offset")
    return pieces.join(places, F.col("pid") == F.col("p")).drop("pid", "p")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
