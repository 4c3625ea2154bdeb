"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Each source gets a target number of words; each of its documents the same fractional copy number
target / size of source. Whole copies are taken as they are, the fractions are rounded: two
documents trade mass (words) until one fraction is 0 or 1, in the direction that keeps every
document's expected copies. Documents of a source are dealt over small groups by hash, each group
leaves at most one fractional document, and the leftovers of the groups form the next level of a
reduction tree, until a source has one, which goes to the nearest whole number. A source's taken words so differ from
its target by half a document at most, and no task holds more than a group.

Random draws are hashes of the seed, the doc_id and the tree's level: reruns agree.

Defined cases: a null text has 0 words; documents without words take 0; null is a source, the
last; rows that repeat a doc_id are separate documents; an empty table gives an empty result;
columns beside doc_id, source and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import free_names, materialize, row_key, table, WORD

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
GROUP = 48


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked_sources(sources: DataFrame) -> DataFrame:
    """Adds rank, the place (from 0) of each distinct source by code point, null last. Sources are
    dealt out by range and numbered within each range, so no task sees them all."""
    order = [F.col("source").isNull(), F.col("source").cast("binary")]
    spread = sources.repartitionByRange(16, *order).withColumn("part", F.spark_partition_id())
    spread = materialize(spread, "sources")
    parts = spread.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return spread.join(F.broadcast(parts.select("part", "before")), "part").withColumn("rank", F.col("before") + F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1).drop("part", "before")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size -> also target. Shares of ``share`` times all sizes go by weight; what a
    source gets beyond ``most`` times its size goes to the others, again and again."""
    ranked = materialize(ranked_sources(sources).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))), "ranked")
    cap = F.col("source_size") * F.lit(float(most))
    total, level, capped = float(ranked.agg(F.sum("source_size")).head()[0] or 0) * share, 0.0, -1
    while True:
        over = cap < F.lit(level) * F.col("weight")
        full, rest, n = ranked.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))).head()
        if n == capped or not rest:
            break
        capped, level = n, (total - (full or 0.0)) / rest
    return ranked.select("source", "source_size", F.least(cap, F.lit(level) * F.col("weight")).alias("target"))


def _draw(salt: Column, *of: Column) -> Column:
    """A number in [0, 1) made of a hash."""
    return F.pmod(F.xxhash64(salt, *of), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _round_group(items: Column, seed: int, level: int) -> Column:
    """items: array of (z words, id, c number, p fraction). Each step trades between the document
    carried along and the next; what becomes whole goes to out. Result: struct(held, out)."""
    held = "struct<z:bigint,id:bigint,c:bigint,p:double>"
    start = F.expr(f"named_struct('held', cast(null as {held}), 'out', cast(array() as array<{held}>))")
    item = lambda x, p: F.struct(x["z"].alias("z"), x["id"].alias("id"), x["c"].alias("c"), p.alias("p"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["held"]
        up = F.least((1 - a["p"]) * a["z"], x["p"] * x["z"])  # words that a can gain from x
        down = F.least(a["p"] * a["z"], (1 - x["p"]) * x["z"])
        gains = _draw(F.lit(seed + level), a["id"], a["c"], x["id"], x["c"]) * (up + down) < down
        a_full, x_empty = (1 - a["p"]) * a["z"] <= x["p"] * x["z"], (1 - a["p"]) * a["z"] >= x["p"] * x["z"]
        a_empty, x_full = a["p"] * a["z"] <= (1 - x["p"]) * x["z"], a["p"] * a["z"] >= (1 - x["p"]) * x["z"]
        pa = F.when(gains, F.when(a_full, 1.0).otherwise(a["p"] + up / a["z"])).otherwise(F.when(a_empty, 0.0).otherwise(a["p"] - down / a["z"]))
        px = F.when(gains, F.when(x_empty, 0.0).otherwise(x["p"] - up / x["z"])).otherwise(F.when(x_full, 1.0).otherwise(x["p"] + down / x["z"]))
        a_done = F.when(gains, a_full).otherwise(a_empty)
        x_done = F.when(gains, x_empty).otherwise(x_full)
        both = F.struct(item(a, pa).alias("a"), item(x, px).alias("x"), a_done.alias("ad"), x_done.alias("xd"))
        none = F.expr(f"cast(null as {held})")
        settle = lambda t: F.struct(
            F.when(t["ad"] & t["xd"], none).when(t["ad"], t["x"]).otherwise(t["a"]).alias("held"),
            F.concat(acc["out"], F.when(t["ad"] & t["xd"], F.array(t["a"], t["x"])).when(t["ad"], F.array(t["a"])).otherwise(F.array(t["x"]))).alias("out"),
        )
        traded = F.element_at(F.transform(F.array(both), settle), 1)
        return F.when(a.isNull(), F.struct(x.alias("held"), acc["out"].alias("out"))).otherwise(traded)

    return F.aggregate(items, start, step)


def round_fractions(rows: DataFrame, seed: int = 0, group: int = GROUP) -> DataFrame:
    """rows: s (number of the source), n (its rows), z words > 0, id, c (tells rows of one id
    apart), 0 < p < 1. Result: id, c, p in {0, 1}."""
    done, level, largest = [], 0, int(rows.agg(F.max("n")).head()[0] or 0)
    while largest:
        wide = F.greatest(F.lit(1), F.ceil(F.col("n") / group)).cast("long")
        dealt = rows.select("s", wide.alias("wide"), F.pmod(F.xxhash64(F.lit(seed + level), "id", "c"), wide).alias("g"), F.struct((-F.col("z")).alias("o"), "id", "c", "z", "p").alias("x"))
        items = F.transform(F.array_sort(F.collect_list("x")), lambda x: F.struct(x["z"].alias("z"), x["id"].alias("id"), x["c"].alias("c"), x["p"].alias("p")))
        tree = dealt.groupBy("s", "wide", "g").agg(items.alias("items")).select("s", F.col("wide").alias("n"), _round_group(F.col("items"), seed, level).alias("r"))
        tree = materialize(tree, f"level{level}")
        done.append(tree.select(F.explode("r.out").alias("x")).select("x.id", "x.c", "x.p"))
        rows = tree.where("r.held is not null").select("s", "n", "r.held.z", "r.held.id", "r.held.c", "r.held.p")
        level, last = level + 1, largest
        largest = -(-largest // group)
        if last <= group:
            done.append(rows.select("id", "c", F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0).alias("p")))
            break
    out = done[0] if done else rows.select("id", "c", "p")
    for x in done[1:]:
        out = out.union(x)
    return out


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken of each row."""
    sized = materialize(docs.select("doc_id", "source", word_count().alias("size")), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("rows"))
    aims = targets(sources.select("source", "source_size")).withColumnRenamed("source", "_s")
    aims = materialize(aims.join(sources.select(F.col("source").alias("_r"), "rows"), F.col("_s").eqNullSafe(F.col("_r"))).drop("_r"), "targets")
    aims = aims.withColumn("_n", F.xxhash64(F.col("_s").isNull(), "_s")).withColumn("fold", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    all_rows = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("k"))
    keyed = all_rows.withColumn("_n", F.xxhash64(F.col("source").isNull(), "source")).select("doc_id", "size", "_n", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("c"))
    keyed = keyed.withColumn("c", F.xxhash64(F.col("c"), "size", "_n", F.col("doc_id").isNull()))
    keyed = materialize(keyed.join(aims.select("_n", "rows", "source_size", "target", "fold"), "_n"), "fractions")
    whole = F.floor(F.col("fold"))
    open_ = keyed.where((F.col("size") > 0) & (F.col("fold") > whole)).select(F.col("_n").alias("s"), F.col("rows").alias("n"), F.col("size").alias("z"), F.coalesce("doc_id", F.lit(-1)).alias("id"), "c", (F.col("fold") - whole).alias("p"))
    rounded = round_fractions(open_, seed).select(F.col("id").alias("_id"), F.col("c").alias("_c"), "p")
    both = keyed.join(rounded, (F.coalesce("doc_id", F.lit(-1)) == F.col("_id")) & (F.col("c") == F.col("_c")), "left")
    copies = F.when(F.col("size") > 0, whole + F.coalesce(F.col("p"), F.lit(0.0)).cast("long")).otherwise(F.lit(0)).cast("long")
    return both.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def resample(docs: DataFrame) -> DataFrame:
    """The documents of the mix: each row as often as the mix takes it, with its own columns. Rows
    are told apart by all their columns; fully equal ones come as often as they are taken together."""
    key, row, copies, n, copy = free_names(docs, "_key", "_row", "_copies", "_n", "_copy")
    keyed = docs.withColumn(key, row_key(docs))
    each = mix(keyed.select(F.col(key).alias("doc_id"), "source", "text")).groupBy("doc_id").agg(F.sum("copies").cast("int").alias(copies), F.count("*").alias(n))
    each = materialize(each.where(F.col(copies) > 0).select(F.col("doc_id").alias(row), copies, n), "copies")

    def of(rows: DataFrame) -> DataFrame:
        return keyed.join(rows, F.col(key) == F.col(row)).drop(key, row, n)

    both = of(each.where(F.col(n) == 1)).union(of(each.where(F.col(n) > 1)).dropDuplicates())
    return both.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(docs.columns)
