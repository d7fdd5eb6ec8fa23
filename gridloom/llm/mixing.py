"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a word budget (`targets`). It is spent on whole epochs of the source
first; what is left goes to its documents in ascending order of -ln(u) / quality, up to the
budget. Nothing but sizes and keys is shuffled, and no source is ever sorted whole: keys fall into ranges
of equal width in their logarithm, sums by range find the one in which a budget ends, and only that one is sorted. An exponential
key of any rate falls in one such range with a probability of 1 / (e * `RANGES`) at most, so it holds about
so small a share of its source whatever the weights are.

Defined results: a null text has size 0; a null source is a source of its own, the last in order;
documents of equal id and text share their key, so they are taken or left together;
an empty table gives an empty mix; a very long text is one document, so a budget is missed by half of it at most;
other columns pass through, whatever their names. u comes from a hash of id and text, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, let, written

#: Ranges to a factor of e in the keys.
RANGES = 1024
CYCLE = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
#: A table of sources with up to this many rows may be broadcast (about 100 bytes a row).
BROADCAST_ROWS = 50_000


def quality_weight(size: Column, length: Column) -> Column:
    """0.02 to 1: lower for short texts and where the mean word is far from six characters."""
    mean = F.log((length + 1) / F.greatest(size, F.lit(1)) / 6.0)
    return F.greatest(F.lit(0.02), F.exp(-F.abs(mean)) * size / (size + 50.0))


def sized(docs: DataFrame, seed: int = 7, text: str = "text") -> DataFrame:
    """docs with word count, sampling key and the key's range."""
    t = F.coalesce(F.col(text), F.lit(""))
    ends = lambda w: (F.element_at(w, 1) == "").cast("long") + ((F.element_at(w, -1) == "") & (F.size(w) > 1)).cast("long")
    df = docs.withColumn("__size", let(F.split(t, SPACE + "+"), lambda w: F.size(w) - ends(w)))
    draw = (F.xxhash64(F.lit(seed), F.col("doc_id"), t).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    df = df.withColumn("__key", -F.log(draw) / quality_weight(F.col("__size"), F.length(t)))
    return df.withColumn("__bucket", F.floor(F.log("__key") * RANGES).cast("int"))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) with column target: the water level at which all budgets add up.

    Sources in code point order, null last, weigh 3, 1, 2, repeating. A budget stops at twice its
    source; what it leaves is shared by weight among the others: those with the smallest
    cap for their weight fill up first, so sums in that order find the level.
    One row a source, so this table is small; its windows run over it alone.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, CYCLE)), ((F.row_number().over(order) - 1) % len(CYCLE) + 1).cast("int"))
    df = sizes.withColumn("__w", w).withColumn("__cap", MOST * F.col("source_size"))
    everything = Window.partitionBy()
    filled = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__all", SHARE * F.sum("source_size").over(everything)).withColumn("__weights", F.sum("__w").over(everything))
    left = F.col("__all") - F.coalesce(F.sum("__cap").over(filled), F.lit(0.0))
    level = left / (F.col("__weights") - F.coalesce(F.sum("__w").over(filled), F.lit(0.0)))
    df = df.withColumn("__level", level)
    # the level at the first source that its share does not fill holds for all from there on
    open_level = F.min(
        F.when(F.col("__level") * F.col("__w") <= F.col("__cap"), F.struct(F.col("__cap") / F.col("__w"), F.col("__level").alias("v"))),
    ).over(everything)["v"]
    target = F.least(F.col("__cap"), F.coalesce(open_level * F.col("__w"), F.col("__cap")))
    return df.select("source", "source_size", target.alias("target"))


def cutoffs(rows: DataFrame) -> DataFrame:
    """For each source its size, target, complete epochs and the last key that the remaining budget reaches."""
    by_bucket = written(rows.groupBy("source", "__bucket").agg(F.sum("__size").alias("__sum")), "mix-buckets")
    plan = written(targets(by_bucket.groupBy("source").agg(F.sum("__sum").alias("source_size"))), "mix-targets")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("epochs", F.least(epochs, F.lit(int(MOST)))).withColumn(
        "__budget",
        F.col("target") - F.col("epochs") * F.col("source_size"),
    )
    before = F.coalesce(F.sum("__sum").over(Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = plan["source"].eqNullSafe(by_bucket["source"])
    ends = by_bucket.withColumn("__before", before).join(F.broadcast(plan) if _few(plan) else plan, same).drop(by_bucket["source"])
    ends = ends.where((F.col("__before") <= F.col("__budget")) & (F.col("__before") + F.col("__sum") > F.col("__budget")))
    ends = written(ends.select(F.col("source").alias("__s"), F.col("__bucket").alias("__b"), "__before", "__budget"), "mix-ends")
    last = rows.join(F.broadcast(ends) if _few(ends) else ends, rows["source"].eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b")))
    # equal keys stand together (rangeBetween), so a tie is never cut
    running = Window.partitionBy("__s").orderBy("__key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = last.withColumn("__reach", F.col("__before") + F.sum("__size").over(running) - F.col("__size") / 2.0)
    keys = last.where(F.col("__reach") <= F.col("__budget")).groupBy("__s").agg(F.max("__key").alias("__last"))
    floor = ends.select("__s", "__b")
    plan = plan.join(floor, plan["source"].eqNullSafe(floor["__s"]), "left").drop("__s")
    plan = plan.join(keys, plan["source"].eqNullSafe(keys["__s"]), "left").drop("__s")
    return plan.select(F.col("source").alias("__s"), "source_size", "target", "epochs", F.col("__b").alias("__end"), "__last")


def _few(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def mix(docs: DataFrame, seed: int = 7, text: str = "text") -> DataFrame:
    """Size, source_size, target and copies (0, 1 or 2) of each document, beside doc_id and source."""
    rows = written(sized(docs.select("doc_id", "source", F.col(text).alias("text")), seed).drop("text"), "mix")
    plan = written(cutoffs(rows), "mix-plan")
    out = rows.join(F.broadcast(plan) if _few(plan) else plan, rows["source"].eqNullSafe(plan["__s"]))
    # no range in which the budget ends: all that is left of the source fits, which is nothing after whole epochs
    chosen = (F.col("__bucket") < F.col("__end")) | ((F.col("__bucket") == F.col("__end")) & (F.col("__key") <= F.col("__last")))
    copies = F.col("epochs") + F.coalesce(chosen, F.lit(False)).cast("long")
    return out.select(
        "doc_id",
        "source",
        F.col("__size").alias("size"),
        "source_size",
        "target",
        F.least(copies, F.lit(int(MOST)).cast("long")).alias("copies"),
        "__key",
    )


def op1(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix itself: docs with its own columns, each row as often as the mix takes it."""
    slim = docs.select("doc_id", "source", "text")
    plan = written(cutoffs(written(sized(slim, seed).drop("text"), "mix")), "mix-plan")
    own = sized(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "doc_id", "source", "text"), seed)
    own = own.select("__row", "source", "__size", "__key", "__bucket")
    out = own.join(F.broadcast(plan) if _few(plan) else plan, own["source"].eqNullSafe(plan["__s"]))
    chosen = (F.col("__bucket") < F.col("__end")) | ((F.col("__bucket") == F.col("__end")) & (F.col("__key") <= F.col("__last")))
    n = F.least(F.col("epochs") + F.coalesce(chosen, F.lit(False)).cast("long"), F.lit(int(MOST)).cast("long")).cast("int")
    return out.where(n > 0).select("__row", F.explode(F.sequence(F.lit(1), n)).alias("__nth")).select("__row.*")
