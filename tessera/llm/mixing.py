"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Within a source a document is expected in the mix e times: e grows with the `tilt`-th power of its size (sizes of one
quarter octave count alike, so that a source has at most 256 classes of them), is at most `most`, and is scaled until the
expected words are the source's target. A document gives floor(e) whole copies, which are certain, and p = e - floor(e) is
its chance of one more. These chances are unequal, and Pareto's order decides: a document's rank is the odds of a random
number, fixed by its content, over the odds of p, and the smallest ranks are taken until their words, with those of whole
copies, reach the target. The sample's size is so fixed to one document's words.

The prefix of the ranks is found without sorting a source: ranks r are laid on 0 .. 2**53 by r / (1 + r), the words of equal
intervals are summed, the interval in which the target lies is cut again, and only documents of the last interval (about one
in 16 million) are ordered. Thus a source with a third of all rows costs what the others cost together. Rows that are equal
in all columns have one rank and are one group of the order, with a number; where the target lies within a group, as many
of its rows as are needed are taken, whichever. Tables with a row for each source are stored first, so that Spark knows
their size and broadcasts them only under its own limit. The order of the sources themselves, a row for each, is one task's sort, which spills.

Defined cases: a null or empty text has size 0 and gives 0 words; it has the chance of the smallest size. A null source is a
source of its own, and comes last. Rows with the same id and different content have different ranks. A source without any
words has target 0. Columns of types that cannot be hashed or grouped (maps) are refused by Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import WORD, documents, stored

WEIGHTS = (1, 2, 3)
MOST = 3
TILT = 0.25
CELLS = 4096
_BLOCK = 10_000


def sizes(docs: DataFrame, seed: int = 0, *more: Column) -> DataFrame:
    """`more`, doc_id, source, size in words, its class, and u in 0 .. 2**53 - 1, random but fixed by a row's content."""
    own = docs.select(
        *more,
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in docs.columns)), 11).alias("u"),
    )
    return own.withColumn("class", F.floor(4 * F.log2(F.greatest("size", F.lit(1)))).cast("int"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size and target of each source.

    Sources in code point order, null last, get `weights` in turn. With all sizes to share, a source gets
    min(most * size, weight * x), where x makes the targets' sum that of all sizes: capped sources' excess is shared by
    weight among the others until none is above. x is found by ordering sources by size / weight: those before a point
    are capped, and the first point that leaves nobody else above its cap is the right one.
    """
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # a row for each source: few, whatever the rows
    place = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    total = total.withColumn("weight", weight.cast("double"))
    by = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    everyone = W.partitionBy()
    capped = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most
    rest = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    total = total.withColumn("x", (F.sum("source_size").over(everyone) - capped) / rest)
    fits = F.when(F.col("x") * F.col("weight") <= F.col("source_size") * most, F.col("x"))
    total = total.withColumn("level", F.first(fits, ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.least(F.col("level") * F.col("weight"), F.col("source_size") * F.lit(float(most)))
    return total.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def chances(sized: DataFrame, shares: DataFrame, most: int = MOST, tilt: float = TILT) -> DataFrame:
    """of, in_class, whole, p and, of the source, source_size, target and part: the words that the sample has to give.

    Classes of a source from the largest on reach the cap `most` first; the scale is that of the first point at which no
    other class does.
    """
    classes = sized.groupBy("source", "class").agg(F.sum("size").alias("words"))
    rows = classes.join(shares.withColumnRenamed("source", "of"), _same("source", "of"))
    weight = F.pow(F.lit(2.0), F.col("class") * F.lit(tilt / 4))
    rows = rows.withColumn("weight", weight)
    by = W.partitionBy("of").orderBy(F.desc("class"))  # at most 256 rows for each source
    before = by.rowsBetween(W.unboundedPreceding, -1)
    after = by.rowsBetween(0, W.unboundedFollowing)
    capped = F.coalesce(F.sum("words").over(before), F.lit(0)) * most
    rest = F.sum(F.col("words") * F.col("weight")).over(after)
    rows = rows.withColumn("scale", F.when(rest > 0, (F.col("target") - capped) / rest))
    fits = F.when(F.col("scale") * F.col("weight") <= most, F.col("scale"))
    rows = rows.withColumn("scale", F.first(fits, ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    # without a point all classes are at the cap
    expected = F.when(F.col("target") <= 0, 0.0).when(F.col("scale").isNull(), float(most)).otherwise(F.least(F.greatest(F.col("scale") * F.col("weight"), F.lit(0.0)), F.lit(float(most))))
    rows = rows.withColumn("whole", F.floor(expected + 1e-12)).withColumn("p", F.greatest(expected - F.col("whole"), F.lit(0.0)))
    rows = rows.withColumn("p", F.when(F.col("p") > 1e-12, F.col("p")).otherwise(0.0))
    part = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(W.partitionBy("of"))
    return rows.select("of", F.col("class").alias("in_class"), "whole", "p", "source_size", "target", part.alias("part"))


def _ranked(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with their class's chances, and v, Pareto's rank r = odds(u) / odds(p) as r / (1 + r) in 0 .. 2**53 - 1."""
    rows = rows.join(plan, _same("source", "of") & (F.col("class") == F.col("in_class"))).drop("of", "in_class")
    u = (F.col("u") + 0.5) / float(2**53)
    low, high = u * (1 - F.col("p")), (1 - u) * F.col("p")
    return rows.withColumn("v", F.when(F.col("p") > 0, F.least(F.floor(low / (low + high) * 2**53), F.lit(2**53 - 1))).cast("long"))


def sample(sized: DataFrame, plan: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """rows, with source_size, target and copies (whole and sampled) of each.

    sized: sizes() of all documents, stored, as it is read several times. plan: chances() of it, stored. rows: the same rows
    with more columns, or sized itself.
    """
    drawn = _ranked(sized, plan).where("p > 0").select("source", "doc_id", "size", "u", "v", "part")
    width = 2**53
    cut = plan.groupBy("of").agg(F.max("part").alias("left")).select("of", F.lit(0).cast("long").alias("low"), "left").where("left > 0")
    for _ in range(2):
        width //= CELLS
        near = drawn.select("source", "size", "v").join(cut, _same("source", "of"))
        near = near.where(F.col("v").between(F.col("low"), F.col("low") + width * CELLS - 1))
        cell = F.floor((F.col("v") - F.col("low")) / width).cast("long")
        sums = near.groupBy("of", "low", "left", cell.alias("cell")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(W.partitionBy("of").orderBy("cell"))  # CELLS rows for each source at most
        sums = sums.withColumn("upto", upto).where("upto >= left")
        first = sums.groupBy("of").agg(F.min(F.struct("cell", "low", "left", "upto", "words")).alias("x"))
        cut = stored(
            first.select("of", (F.col("x.low") + F.col("x.cell") * width).alias("low"), (F.col("x.left") - (F.col("x.upto") - F.col("x.words"))).alias("left")),
            "cuts",
        )
    # groups of equal rows of the last interval, in the order of their ranks: how many of a group's rows come nearest to the target
    key = F.struct("v", "u", "size", "doc_id")
    near = drawn.join(cut, _same("source", "of")).where(F.col("v").between(F.col("low"), F.col("low") + width - 1))
    near = near.groupBy("of", "low", "left", key.alias("group")).agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("of").orderBy("group")
    upto = F.coalesce(F.sum(F.col("n") * F.col("group.size")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    fit = F.when(F.col("group.size") > 0, F.round((F.col("left") - upto) / F.col("group.size"))).otherwise(F.col("n"))
    near = near.withColumn("fit", F.greatest(F.least(fit.cast("long"), F.col("n")), F.lit(0).cast("long")))
    # groups before the edge are in, the edge gives `fit` of its rows, groups after it are out
    short = near.where("fit < n").groupBy(F.col("of").alias("edge_of"), F.col("low").alias("edge_low")).agg(F.min(F.struct("group", "fit")).alias("edge"))
    edges = stored(cut.join(short, _same("of", "edge_of"), "left").select(F.col("of").alias("cut_of"), "low", "edge"), "cuts")
    wide = rows is not None
    out = _ranked(rows if wide else sized, plan)
    out = out.join(edges, _same("source", "cut_of"), "left")
    # without a cut the ranks don't reach the words wanted: all are in, or with nothing wanted none
    before = F.coalesce(key < F.col("edge.group"), F.col("v") < F.col("low") + width)
    taken = F.when(F.col("p") == 0, False).when(F.col("low").isNull(), F.col("part") > 0).otherwise(before)
    out = out.withColumn("copies", F.col("whole") + taken.cast("long"))
    edge = (F.col("p") > 0) & F.coalesce(key == F.col("edge.group"), F.lit(False))
    names = [c for c in (rows if wide else sized).columns if c not in ("u", "class")] + ["source_size", "target", "copies"]
    others = out.where(~edge).select(*names)
    # the edge's rows are equal, so that they are counted and laid out anew, in blocks of a bounded length
    equal = out.where(edge).groupBy(*names, F.col("edge.fit").alias("fit")).agg(F.count(F.lit(1)).alias("n"))
    equal = equal.withColumn("begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(_BLOCK))))
    equal = equal.withColumn("i", F.explode(F.sequence("begin", F.least(F.col("begin") + _BLOCK, F.col("n")) - 1)))
    equal = equal.withColumn("copies", F.col("copies") + (F.col("i") < F.col("fit")).cast("long"))
    return others.unionByName(equal.select(*names))


def _plan(sized: DataFrame, weights: tuple[int, ...], most: int, tilt: float) -> DataFrame:
    return stored(chances(sized, stored(targets(sized, weights, most), "mix-targets"), most, tilt), "mix-chances")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0, tilt: float = TILT) -> DataFrame:
    """doc_id, source, size, source_size, target and copies of every row of docs(doc_id, source, text)."""
    sized = stored(sizes(docs, seed), "mix-sizes")
    return sample(sized, _plan(sized, weights, most, tilt))


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0, tilt: float = TILT) -> DataFrame:
    """The mix itself: docs' columns, each row as many times as the mix takes it. Texts are not shuffled, but for rows equal to the edge of a sample."""
    sized = stored(sizes(docs, seed), "mix-sizes")
    rows = sizes(docs, seed, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    taken = sample(sized, _plan(sized, weights, most, tilt), rows).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = F.col("size") * F.col("copies")
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "copies")
