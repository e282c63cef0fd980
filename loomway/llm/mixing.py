"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

A source's target over its size is the copies each of its documents should get; the whole part is given outright,
the fraction by pivotal rounding: two documents' fractions are moved against each other, words for words, in a random
direction until one is 0 or 1. Chunks of bounded size are swept so at once; what stays fractional in a chunk goes to
the next level of a reduction tree, until one document of each source is left. Long documents are rounded first, so that
this last one is short.

Defined results: a null text has size 0; a null source is a source of its own, the last; rows that share a source and
an id (null ids too) are one unit and get the same copies; documents of size 0 are rounded each by itself; a source
without words has target 0; an empty table gives an empty result. Other columns are carried along untouched. Random
numbers come from a hash of ids and the seed, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..core import materialize, table
from .common import BROADCAST_ROWS, WORD, small

#: Weights of the sources in their order, the mix's share of all words, and the most of a source as a multiple of it.
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0
#: Documents that one task's array holds, about.
FAN_IN = 256
#: Binary digits of a size that make a tier.
TIER_BITS = 5


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """``source, source_size`` with each source's ``target``: shares of ``share`` times all sizes by weight, at most
    ``cap`` times the source's size, the excess going to the others by weight. One row per source, sorted in one task."""
    order = Window.orderBy(F.asc_nulls_last("source"))
    kinds = F.array(*(F.lit(float(w)) for w in weights))
    s = sizes.withColumn("weight", F.get(kinds, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int"))).withColumn("most", F.col("source_size") * cap)
    full = Window.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source"))
    every = Window.partitionBy()
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    # the level at which water stands if all sources before this one, in the order of filling up, are full
    s = s.withColumn("all", F.sum("source_size").over(every) * share).withColumn("w_all", F.sum("weight").over(every))
    s = s.withColumn("w_left", F.col("w_all") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).withColumn("left", F.col("all") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / F.col("w_left")).withColumn("open", F.col("level") * F.col("weight") < F.col("most"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("most") / F.col("weight"), F.col("level").alias("level")))).over(every)["level"]
    return s.withColumn("level", level).select("source", "source_size", F.coalesce(F.least(F.col("level") * F.col("weight"), "most"), "most").alias("target"))


def _size(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def _uniform(*cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _sweep(items: Column, seed: int) -> Column:
    """Pivotal rounding along an array of ``(u, id, w, p)``: struct of ``hold``, the one still open, and ``done``."""
    item = "struct<w:bigint,u:double,id:bigint,p:double>"
    fixed = "array<struct<id:bigint,up:int>>"

    def made(x: Column, p: Column) -> Column:
        return F.struct(x["w"].alias("w"), x["u"].alias("u"), x["id"].alias("id"), p.alias("p"))

    def step(a: Column, x: Column) -> Column:
        h = a["hold"]
        hw, xw = h["w"], x["w"]
        up = F.least((1 - h["p"]) * hw, x["p"] * xw)  # words that can move to the held one
        down = F.least(h["p"] * hw, (1 - x["p"]) * xw)
        gives = _uniform(h["u"], x["u"], F.lit(seed)) * (up + down) < down
        h_full, x_empty = (1 - h["p"]) * hw <= x["p"] * xw, h["p"] * hw <= (1 - x["p"]) * xw
        settled = F.when(gives, h_full).otherwise(x_empty)  # is it the held one that becomes whole
        value = F.when(gives, F.when(h_full, 1).otherwise(0)).otherwise(F.when(x_empty, 0).otherwise(1))
        moved = F.when(gives, up).otherwise(-down)
        hold = F.when(settled, made(x, x["p"] - moved / xw)).otherwise(made(h, h["p"] + moved / hw))
        one = F.struct(F.when(settled, h["id"]).otherwise(x["id"]).alias("id"), value.cast("int").alias("up"))
        return F.when(h.isNull(), F.struct(x.cast(item).alias("hold"), a["done"].alias("done"))).otherwise(
            F.struct(hold.cast(item).alias("hold"), F.concat(a["done"], F.array(one).cast(fixed)).alias("done"))
        )

    zero = F.struct(F.lit(None).cast(item).alias("hold"), F.array().cast(fixed).alias("done"))
    return F.aggregate(items, zero, step)


def _tree(items: DataFrame, seed: int) -> tuple[list[DataFrame], DataFrame]:
    """Pivotal rounding of ``source, n, u, id, w, p`` (n: documents of the source): whole decisions ``source, id, up``, and
    the one document of each source that is still open, as it came but for its ``p``."""
    left, done, level = items, [], 0
    while True:
        held = left.withColumn("chunk", F.pmod(F.xxhash64("u", F.lit(seed + level)), F.ceil(F.col("n") / FAN_IN))).groupBy("source", "n", "chunk")
        swept = materialize(held.agg(_sweep(F.sort_array(F.collect_list(F.struct("w", "u", "id", "p")), asc=False), seed + level).alias("s")))
        done.append(swept.select("source", F.explode("s.done").alias("d")).select("source", F.col("d.id").alias("id"), "d.up"))
        left = swept.filter("s.hold is not null").select("source", F.ceil(F.col("n") / FAN_IN).alias("n"), "s.hold.*")
        if not left.filter("n > 1").take(1):
            return done, left
        level += 1


def copies(units: DataFrame, plan: DataFrame, seed: int = 0) -> DataFrame:
    """``source, id, copies`` for units ``source, id, w``; plan: ``source, source_size, target``.

    Long documents are rounded before short ones, tier by tier of their size's order. The one that a tier leaves open is
    decided by its fraction (or the other way where shorter ones could not make up for that), and what it takes too much
    or too little is spread over the fractions of the next tier, and on from there where these would leave 0 to 1. So a
    source misses its target by less than the longest document of its last tier, if its shorter documents can make up for
    the longer ones at all, and documents are expected as often as their fractions say.
    """
    per = units.withColumn("tier", F.floor((F.length(F.bin("w")) - 1) / TIER_BITS).cast("int"))
    per = per.withColumn("u", _uniform(F.col("id"), F.lit(seed)))
    found = per.filter("w > 0").groupBy("source", "tier").agg(F.sum("w").alias("all"), F.count("*").alias("n"))
    found = found.groupBy(F.col("source").alias("s")).agg(F.map_from_entries(F.collect_list(F.struct("tier", F.struct("all", "n")))).alias("tiers"))  # a dozen
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    state = plan.join(found, F.col("source").eqNullSafe(F.col("s")), "left").select("source", F.floor(ratio).cast("int").alias("base"), (ratio - F.floor(ratio)).alias("p"), "tiers", F.lit(0.0).alias("owe"))
    state = first = materialize(state)
    at = lambda df: F.broadcast(df) if sources <= BROADCAST_ROWS else df
    sources = first.count()
    base = lambda df: df.join(at(first.select(F.col("source").alias("s"), "base")), F.col("source").eqNullSafe(F.col("s")))
    none = per.filter("w = 0").join(at(first.select(F.col("source").alias("s"), "base", "p")), F.col("source").eqNullSafe(F.col("s")))
    done = [none.select("source", "id", (F.col("base") + (F.col("u") < F.col("p")).cast("int")).alias("copies"))]
    for (tier,) in sorted(first.select(F.explode(F.map_keys("tiers"))).distinct().collect(), reverse=True):  # one for each order of size
        here = F.col("tiers")[F.lit(tier)]
        want = F.col("p") + F.coalesce(F.col("owe") / here["all"], F.lit(0.0))
        low = F.aggregate(F.map_values(F.map_filter("tiers", lambda k, v: k < tier)), F.lit(0).cast("long"), lambda a, x: a + x["all"])
        now = state.withColumn("q", F.greatest(F.lit(0.0), F.least(F.lit(1.0), want))).withColumn("rest", F.when(here.isNull(), F.col("owe")).otherwise((want - F.col("q")) * here["all"])).withColumn("low", low)
        mine = per.filter(F.col("tier") == tier).filter("w > 0").join(at(now.select(F.col("source").alias("s"), "q", here["n"].alias("n"))), F.col("source").eqNullSafe(F.col("s")))
        mine = mine.select("source", "n", "u", "id", "w", F.col("q").alias("p"))
        swept, last = _tree(mine.filter("p > 0 and p < 1"), seed + 100 * tier)
        last = last.select(F.col("source").alias("l"), "id", "w", F.col("p").alias("f"), _uniform(F.col("u"), F.lit(seed + 100 * tier), F.lit("last")).alias("x"))
        now = now.join(at(last), F.col("source").eqNullSafe(F.col("l")), "left")
        # what shorter documents can give and take beyond their fractions
        over = lambda owe: F.greatest(owe - (1 - F.col("p")) * F.col("low"), -owe - F.col("p") * F.col("low"), F.lit(0.0))
        if_up, if_down = F.col("rest") + (F.col("f") - 1) * F.col("w"), F.col("rest") + F.col("f") * F.col("w")
        up = F.when(over(if_up) < over(if_down), 1).when(over(if_up) > over(if_down), 0).otherwise((F.col("x") < F.col("f")).cast("int"))
        state = materialize(now.withColumn("up", up).select("source", "p", "tiers", "id", "up", F.when(F.col("id").isNull() & F.col("w").isNull(), F.col("rest")).when(F.col("up") == 1, if_up).otherwise(if_down).alias("owe"), F.col("w").isNotNull().alias("had")))
        sure = mine.filter("p <= 0 or p >= 1").select("source", "id", F.col("p").cast("int").alias("up"))
        for d in [sure, *swept, state.filter("had").select("source", "id", "up")]:
            done.append(base(d).select("source", "id", (F.col("base") + F.col("up")).alias("copies")))
        state = state.select("source", "p", "tiers", "owe")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", slim: bool = False) -> DataFrame:
    """``row`` (the input row, or nothing but its id if ``slim``) with ``size, source_size, target, copies``."""
    row = F.struct(F.col(id_col).alias("doc_id")) if slim else F.struct("*")
    rows = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), _size(text_col).alias("size"))
    if slim:
        rows = materialize(rows)
    units = materialize(rows.groupBy("source", "id").agg(F.sum("size").alias("w")))
    plan = materialize(targets(units.groupBy("source").agg(F.sum("w").alias("source_size")), weights, share, cap))
    got = copies(units, plan, seed).select(F.col("source").alias("s"), F.col("id").alias("i"), "copies")
    rows = rows.join(got, F.col("id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "i")
    return rows.join(small(plan.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")), "left").select("row", "size", "source_size", "target", F.coalesce("copies", F.lit(0)).alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row as often as it has copies; same columns."""
    return mix(docs, **options).filter("copies > 0").select(F.col("row"), F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents"), slim=True)
    return m.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``op8_mix_sources`` aims at, source by source; this part SQL can express."""
    d = table(spark, sf_dir, "documents").select("source", _size("text").alias("size"))
    per = materialize(d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"), F.max("size").alias("longest")))
    plan = targets(per.select("source", "source_size"), WEIGHTS, SHARE, CAP).select(F.col("source").alias("s"), F.round("target", 3).alias("target"))
    return per.join(plan, F.col("source").eqNullSafe(F.col("s"))).select("source", "source_size", "target", "n_docs", "longest")


TARGETS_ORACLE = r"""
WITH d AS (SELECT source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, count(*) AS n_docs, max(size)::BIGINT AS longest FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s),
-- at every level that fills some source, what all sources together would take
l AS (SELECT a.source, 2 * a.n / a.w AS level, sum(least(2 * a.n / a.w * b.w, 2.0 * b.n)) AS takes FROM w a, w b GROUP BY ALL),
f AS (SELECT coalesce(max(level) FILTER (takes <= 1.5 * (SELECT sum(n) FROM s)), 0) AS level FROM l),
o AS (SELECT (1.5 * (SELECT sum(n) FROM s) - coalesce(sum(2.0 * n) FILTER (2 * n / w <= level), 0)) / nullif(sum(w) FILTER (2 * n / w > level), 0) AS per FROM w, f)
SELECT source, n AS source_size, round(CASE WHEN per IS NULL THEN 2.0 * n ELSE least(per * w, 2.0 * n) END, 3) AS target, n_docs, longest FROM w, o
"""
