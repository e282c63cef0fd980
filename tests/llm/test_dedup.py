"""Duplicates of documents, lines and passages against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomway.llm import exact_dedup, line_dedup, near_dedup, suffix_dedup
from loomway.llm.line_dedup import PerfectHash

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


def ascii_lower(t):
    return t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


@pytest.mark.parametrize("run_rows", [2, 1000])
def test_exact(docs, run_rows):
    texts = ["Same", "same", "SAME", None, "", "É", "é", "x" * 200 + "a", "x" * 200 + "b", "same", "same ", "sAme"]
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts, 1)] + [(None, "same", None, None, None), (12, "same", None, None, None), (99, "É", None, None, None)]
    got = exact_dedup.content_sort(docs(*rows), keep="largest", run_rows=run_rows).collect()
    groups: dict = {}
    for i, t, *_ in rows:
        groups.setdefault(ascii_lower(t or ""), []).append(i)
    assert len(got) == len(rows)
    want = {(i, max(x for x in g if x is not None), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got} == want
    assert sorted(r["doc_id"] for r in got if r["kept"]) == sorted(max(x for x in g if x is not None) for g in groups.values())
    assert exact_dedup.content_sort(docs(*rows).limit(0)).count() == 0
    assert sorted(r["doc_id"] for r in exact_dedup.content_sort(docs("a", "A", "b")).filter("kept").collect()) == [1, 3]


def test_exact_takes_clashing_columns(docs):
    d = docs("a", "a").withColumn("body", F.lit(1)).withColumn("h", F.lit(2)).withColumn("run", F.lit(3)).withColumn("kept", F.lit(4))
    assert exact_dedup.content_sort(d).filter("kept").count() == 1


def lines_by_hand(rows, least=40, min_docs=5):
    key = lambda x: ascii_lower(x.strip(" \t\n\x0b\x0c\r"))
    seen: dict = {}
    for n, (i, t) in enumerate(rows):
        for x in set(map(key, (t or "").split("\n"))):
            if len(x) >= least:
                seen.setdefault(x, {})[n] = i
    out = []
    for i, t in rows:
        x = (t or "").split("\n")
        gone = [len(seen.get(key(y), ())) >= min_docs and i != max(z for z in seen[key(y)].values() if z is not None) for y in x]
        out.append((i, len(x), sum(gone), "\n".join(y for y, g in zip(x, gone) if not g)))
    return out


@pytest.mark.parametrize(("options", "least_hot"), [({}, 1000), ({"shard_keys": 7}, 6)])
def test_lines(docs, monkeypatch, options, least_hot):
    monkeypatch.setattr(line_dedup, "LEAST_HOT", least_hot)
    common = ["A line that very many documents share, word for word", "Übermäßig lange Zeile, die sich überall wiederholt", "short shared line", "x" * 39, "y" * 40]
    r = random.Random(3)
    rows = []
    for i in range(1, 30):
        own = [r.choice([c, c.upper() if c.isascii() else c, f"  {c}\t", c + "!"]) for c in r.sample(common, r.randint(0, 5))] + [prose(i, 12)]
        rows.append((i, "\n".join(own * r.randint(1, 2))))
    rows += [(30, None), (31, ""), (32, "\n\n"), (None, "y" * 40), (33, rows[0][1]), (33, rows[0][1]), (33, rows[1][1]), (None, rows[0][1])]
    got = line_dedup.drop_lines(docs(*[(i, t, None, None, None) for i, t in rows]), **options)
    got = [(x["row"]["doc_id"], x["n_lines"], x["n_dropped"], x["kept_text"]) for x in got.collect()]
    assert sorted(got, key=str) == sorted(lines_by_hand(rows), key=str)
    assert sum(x[2] for x in got) > 10
    assert line_dedup.without_shared_lines(docs("a").limit(0)).count() == 0


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 1 << 63, (20_000, 2), dtype=np.uint64)
    keys[:100, 0] = 7  # told apart by their other half
    h = PerfectHash(keys)
    assert sorted(h.find(keys).tolist()) == list(range(len(keys)))
    assert h.find(np.arange(200, dtype=np.uint64).reshape(-1, 2)).max() < len(keys)
    assert PerfectHash(keys[:0]).find(keys[:5]).tolist() == [-1] * 5


def test_shards_hold_counts_and_keepers():
    rows = pd.DataFrame({"k1": range(50), "k2": [1 << 40] * 50, "n": range(50), "keeper": pd.array([None if k == 9 else k for k in range(50)], "Int64")})
    keys = np.stack([np.arange(60, dtype=np.uint64), np.full(60, 1 << 40, np.uint64)], 1)
    known, take = line_dedup.Shard.of(rows).probe(keys, np.full(60, 7), np.zeros(60, bool), 5)
    assert known[:50].all() and np.flatnonzero(take & (np.arange(60) < 50)).tolist() == [k for k in range(5, 50) if k != 7]
    known, take = line_dedup.Shard.of(rows).probe(keys[:10], np.zeros(10, np.int64), np.ones(10, bool), 9)
    assert not take.any() and known.all()
    assert not line_dedup.Shard.of(rows[:0]).probe(keys, np.zeros(60, np.int64), np.ones(60, bool), 1)[0].any()


def near_by_hand(rows, width, percent):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t or ""))
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            up[top(b)] = top(a)
    least: dict = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return sorted(((i, len(sets[k]), least.get(top(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("block", [256, 6])
def test_near(docs, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "PIVOTS", 2)
    r = random.Random(5)
    rows, n = [], itertools.count(1)
    for g in range(6):
        base = prose(g, 80).split()
        for _ in range(r.choice([1, 2, 3, 25])):
            copy = list(base)
            for _ in range(r.randint(0, 5)):
                copy[r.randrange(len(copy))] = "odd" + str(r.randint(0, 10**6))
            rows.append((next(n), " ".join(copy)))
    shared = prose(77, 30)
    rows += [(next(n), shared + " " + prose(100 + k, 30)) for k in range(12)]
    rows += [(500, None), (501, ""), (502, " \t"), (503, "two words"), (504, "Two  words"), (505, "a b c d"), (505, "a b c d"), (None, rows[0][1]), (None, "nobody else has this text here at all")]
    lost = prose(900, 80)
    rows += [(None, lost), (None, lost + " end"), (None, lost), (None, prose(901, 80)), (None, None)]
    got = near_dedup.components(docs(*[(i, t, None, None, None) for i, t in rows]), width=4).collect()
    assert sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got), key=str) == near_by_hand(rows, 4, 80)
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in got)


CLASHING = ("row", "perhaps", "bit", "page", "map", "gone", "id", "w", "who", "said", "body", "lines", "th", "kept", "text_", "n", "part", "h", "_bit", "_page", "_map", "_perhaps_", "_gone_", "_left_", "_clean_")


def clashing(d):
    """Columns that have the names of the operators' own, with values that tell rows apart."""
    return d.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING})


def carried(rows):
    return all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in CLASHING)


def test_near_keeps_one(docs):
    base = prose(1, 60)
    d = clashing(docs(base, base + " more", prose(2, 60), None, base))
    got = near_dedup.keep_one(d)
    assert got.columns == d.columns
    assert sorted(x["doc_id"] for x in got.collect()) == [1, 3, 4] and carried(got.collect())
    assert near_dedup.keep_one(docs("a").limit(0)).count() == 0


def test_lines_take_clashing_columns(docs):
    line = "A line that very many documents share, word for word"
    d = clashing(docs(*[f"{line}\nown {i}" for i in range(1, 8)]))
    got = line_dedup.without_shared_lines(d)
    assert got.columns == d.columns and carried(got.collect())
    assert sorted(r["text"] for r in got.collect()) == [f"{line}\nown 7", *(f"own {i}" for i in range(1, 7))] and {r["n_chars"] for r in got.collect()} == {5, len(line) + 6}


def test_passages_take_clashing_columns(docs):
    a = prose(1, 40)
    got = suffix_dedup.remove_repeats(clashing(docs(a, a)).drop("id")).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(1, 0), (2, len(a))]


def test_very_long_texts(docs):
    """A text of a million characters with passages, lines and words like those of others."""
    long = "\n".join(prose(k, 40) for k in range(4000))
    d = docs(long, long[:5000], long + " end", "short", None)
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(d).collect()}
    assert got[1]["n_bytes"] == len(long) > 10**6 and [got[i]["n_removed"] for i in (2, 3)] == [5000, len(long)]
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.components(d).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
    assert sum(r["n_dropped"] for r in line_dedup.drop_lines(d, min_docs=2).collect()) == 4000 + len(long[:5000].split("\n")) - 2
    assert {r["doc_id"]: r["group_size"] for r in exact_dedup.content_sort(docs(long, long.upper(), long + "!")).collect()} == {1: 2, 2: 2, 3: 1}


def repeats_by_hand(rows, width=100):
    seen, out = {}, []
    for i, t in sorted(rows, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if seen.setdefault(b[k : k + width], (i, k)) != (i, k):
                gone[k : k + width] = b"\1" * width
        out.append((i, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize(("group", "least_hot"), [(2_000, 20), (2, 20), (2, 1), (2_000, 1)])
def test_passages(docs, monkeypatch, group, least_hot):
    monkeypatch.setattr(suffix_dedup, "GROUP_ROWS", group)
    monkeypatch.setattr(suffix_dedup, "LEAST_HOT", least_hot)
    monkeypatch.setattr(suffix_dedup, "HOT_SHARE", 10**6)
    a, b = prose(1, 40), prose(2, 30)
    rows = [a, b + a[50:] + b, a[:99], a[:100], a[1:101], "é" * 60, "ü" + "é" * 60, "z" * 350, "z" * 90, None, "", prose(3, 20) + a[20:119] + prose(4, 20), prose(5, 20) + a[20:125] + prose(6, 20), a, a[:60] + b[:60]]
    rows += [prose(10 + k, 9) + a[100:260] + prose(30 + k, 9) for k in range(8)]
    rows = list(enumerate(rows, 1))
    got = suffix_dedup.remove_repeats(docs(*[(i, t, None, None, None) for i, t in rows])).orderBy("doc_id").collect()
    assert [tuple(x) for x in got] == repeats_by_hand(rows)


def test_passages_refined():
    """Windows of a bucket, also where all q-grams seem to share their hash."""
    r = random.Random(8)
    core, texts, left = "anchor of twenty-eight bytes", [], []
    for k in range(60):
        a, z = r.choice(["", prose(1, 20)[:72], prose(2, 20)[-40:]])[-r.randint(1, 72) :], r.choice([prose(3, 20), prose(4, 20)[:50] + prose(3, 20)[50:]])[: r.choice([72, 72, 60, 30])]
        texts.append((a + core + z).encode())
        left.append(len(a))
    left = np.array(left)
    want = set()
    for i, t in enumerate(texts):
        for p in range(len(t) - 99):
            same = [j for j, u in enumerate(texts[:i]) for q in [p - left[i] + left[j]] if q >= 0 and u[q : q + 100] == t[p : p + 100]]
            if same:
                want.add((i, p - left[i] + suffix_dedup.BACK, min(same)))
    h = np.zeros(60, np.int64)
    assert want and set(zip(*(x.tolist() for x in suffix_dedup.refined(h, left, texts)))) == want
    data, begin, end = suffix_dedup.laid_out(left, texts)
    assert [data[i, a:z].tobytes() for i, (a, z) in enumerate(zip(begin, end))] == texts


def test_passages_with_colliding_hashes(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "mix", lambda x: x & suffix_dedup.U(0))
    texts = [(f"{k % 3}" * 172).encode() for k in range(6)]
    row, p, first = suffix_dedup.refined(np.zeros(6, np.int64), np.full(6, suffix_dedup.BACK), texts)
    assert set(zip(row.tolist(), first.tolist())) == {(3, 0), (4, 1), (5, 2)} and sorted(set(p.tolist())) == list(range(73))


def test_passages_with_odd_ids(docs):
    a = prose(1, 40)
    got = suffix_dedup.remove_repeats(docs((None, a, None, None, None), (2, a, None, None, None), (3, a, None, None, None), (3, a, None, None, None)), with_text=True).collect()
    assert sorted(((x["doc_id"], x["n_removed"]) for x in got), key=str) == sorted([(2, 0), (3, len(a)), (3, len(a)), (None, len(a))], key=str)
    assert {x["kept"] for x in got if x["doc_id"] == 2} == {a.encode()}
    assert suffix_dedup.remove_repeats(docs("a").limit(0)).count() == 0


def test_near_pair_with_unlucky_minhashes(docs):
    pool = [f"w{i}" for i in range(3000)]
    h = np.concatenate(list(near_dedup.shingle_sets(pa.array(pool), 1)))
    v = h[:, None] * near_dedup._MULTIPLIERS + near_dedup._ADDENDS
    least, own = v[:80].min(0), []
    for _ in range(20):  # words that are the least of as many minhashes as possible
        own.append(80 + int((v[80:] < least).sum(1).argmax()))
        least = np.minimum(least, v[own[-1]])
    assert (least == v[:80].min(0)).sum() < 158
    texts = [" ".join(pool[:80] + [pool[i] for i in own]), " ".join(pool[:80])]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.components(docs(*texts), width=1).collect()}
    assert got == {1: 1, 2: 1}
