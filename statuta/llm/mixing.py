"""Mixing sources to target shares of the total size, by Pareto order sampling.

Method. A source that must supply more than it holds gives whole copies of all its documents first;
the fraction left is a sample without replacement. Each document has an inclusion probability; documents
are ranked by the odds of a random number divided by their inclusion odds, and the first ones whose
sizes reach the residual target are taken. The place of the cut is found by histograms of the ranks,
so that no source, however large, is sorted or gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statuta.session import cut, small

BINS = 4096


def source_key(column):
    """Sources are compared without case and padding."""
    return F.lower(F.regexp_replace(column, r"^\s+|\s+$", ""))


def plan(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """``source, share, cap, size, docs, target, whole, fraction`` for the sources present.

    ``sizes``: ``source, size`` per document. Weights are rescaled over the sources that have any
    size. Without ``total`` the mixture is the largest in which every source reaches its share
    within its cap; with it, a source that would pass its cap supplies its cap.
    """
    have = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs")).where("size > 0")
    wanted = (
        targets.select(source_key(F.col("source")).alias("source"), F.col("weight"), F.coalesce("max_repeats", F.lit(1)).alias("cap"))
        .where("source IS NOT NULL AND weight > 0 AND cap > 0")
        .groupBy("source").agg(F.sum("weight").alias("weight"), F.max("cap").alias("cap"))
    )
    present = wanted.join(have, "source")
    # One row per target source: the window over all of them is as small as the table of targets.
    all_sources = Window.partitionBy(F.lit(0))
    shares = present.withColumn("share", F.col("weight") / F.sum("weight").over(all_sources))
    most = F.min(F.col("cap") * F.col("size") / F.col("share")).over(all_sources)
    sized = shares.withColumn("all", most if total is None else F.lit(float(total)))
    target = F.least(F.col("share") * F.col("all"), F.col("cap") * F.col("size").cast("double"))
    # A hair below a whole number counts as the whole number.
    copies = F.col("target") / F.col("size")
    return (
        sized.withColumn("target", target)
        .withColumn("whole", F.floor(copies + 1e-9).cast("int"))
        .withColumn("fraction", F.greatest(copies - F.col("whole"), F.lit(0.0)))
        .select("source", "share", "cap", "size", "docs", "target", "whole", "fraction")
    )


def _rates(docs: DataFrame, plans: DataFrame, weighted: bool) -> DataFrame:
    """``source, cap, rate``: a document's expected copies are its weight times the rate, at most the cap.

    Documents at the cap leave the rest of the target to the others, whose rate then rises; the rounds end
    when no further document reaches its cap. Equal weights need no round.
    """
    sums = docs.groupBy("source").agg(F.sum(F.col("weight") * F.col("size")).alias("mass"))
    rates = cut(plans.join(sums, "source").select("source", "cap", "target", (F.col("target") / F.col("mass")).alias("rate"), F.lit(0).cast("long").alias("capped")))
    while weighted:
        at = docs.join(small(rates), "source")
        full = F.col("weight") * F.col("rate") >= F.col("cap")
        agg = at.groupBy("source").agg(
            F.sum(F.when(full, F.col("cap") * F.col("size")).otherwise(0)).alias("fixed"),
            F.sum(F.when(~full, F.col("weight") * F.col("size")).otherwise(0.0)).alias("open"), F.count_if(full).alias("now"),
        )
        rate = F.when(F.col("open") > 0, F.greatest((F.col("target") - F.col("fixed")) / F.col("open"), F.lit(0.0))).otherwise(F.col("rate"))
        grown = cut(rates.join(agg, "source").withColumn("more", F.col("now") > F.col("capped")).select(
            "source", "cap", "target", F.when(F.col("more"), rate).otherwise(F.col("rate")).alias("rate"), F.col("now").alias("capped"), "more"
        ))
        rates = grown.drop("more")
        if grown.where("more").isEmpty():
            break
    return rates.select("source", "cap", "rate")


def _ranked(docs: DataFrame, rates: DataFrame, seed: int) -> DataFrame:
    """Documents with their copies and ``x`` in (0, 1), increasing in the Pareto rank; the order is a hash, so it is repeatable."""
    u = (F.pmod(F.xxhash64(F.col("doc"), F.col("source"), F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    copies = F.least(F.col("weight") * F.col("rate"), F.col("cap").cast("double"))
    # A hair below a whole number counts as the whole number.
    joined = docs.join(small(rates), "source").withColumn("e", copies).withColumn("whole", F.floor(F.col("e") + 1e-9).cast("int"))
    joined = joined.withColumn("fraction", F.greatest(F.col("e") - F.col("whole"), F.lit(0.0)))
    p = F.least(F.greatest(F.col("fraction"), F.lit(1e-12)), F.lit(1 - 1e-12))
    q = (u / (1 - u)) / (p / (1 - p))
    return joined.withColumn("x", q / (1 + q)).drop("e", "rate", "cap")


def _edge(bins: DataFrame) -> DataFrame:
    """The bin of each source in which the running size passes what is needed, and the size before it."""
    order = Window.partitionBy("source").orderBy("bin")
    run = bins.withColumn("upto", F.sum("size").over(order))
    hit = run.where(F.col("upto") >= F.col("need"))
    first = hit.groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("size")).alias("before"))).alias("e"))
    return first.select("source", F.col("e.bin").alias("bin"), F.col("e.before").alias("before"))


def mixture(
    documents: DataFrame, targets: DataFrame, size: str = "tokens", doc: str = "doc_id", source: str = "source",
    total: float | None = None, seed: int = 17, weight: str | None = None,
) -> DataFrame:
    """``source, doc, size, copies``: the documents of the mixture and how often each is in it.

    ``weight`` names a column of relative weights within a source: a document's expected copies are
    proportional to it, up to the cap; without it all documents of a source are alike. Null, negative
    and zero weights leave a document out.

    Every source comes as close to its target as whole documents allow: it misses it by half its largest document at
    most, since documents are taken while the one in question is nearer to the rest than nothing. No document comes
    more often than its source's cap. Documents of sources without a target, with a null source or null key, or of no
    size are not in it (of no size: they are no part of any share). Ties of rank go to the smaller key.
    """
    base = documents.select(
        source_key(F.col(f"`{source}`")).alias("source"), F.col(f"`{doc}`").alias("doc"), F.col(f"`{size}`").cast("long").alias("size"),
        (F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)).alias("weight"),
    ).where("source IS NOT NULL AND doc IS NOT NULL AND size > 0 AND weight > 0")
    base = cut(base)
    # As many rows as target sources; each side of that size is measured before it is broadcast.
    plans = cut(plan(base, targets, total))
    ranked = _ranked(base, cut(_rates(base, plans, weight is not None)), seed)
    needs = cut(ranked.groupBy("source").agg(F.sum(F.col("fraction") * F.col("size")).alias("need")))
    ranked = ranked.join(small(needs), "source").withColumn("b1", F.floor(F.col("x") * BINS)).withColumn(
        "b2", F.floor(F.col("x") * BINS * BINS) % BINS
    )
    sampled = ranked.where("fraction > 0 AND need > 0")
    one = _edge(sampled.groupBy("source", F.col("b1").alias("bin")).agg(F.sum("size").alias("size"), F.max("need").alias("need")))
    one = cut(one.select("source", F.col("bin").alias("e1"), F.col("before").alias("before1")))
    inside = sampled.join(small(one), "source").where("b1 = e1").withColumn("need", F.col("need") - F.col("before1"))
    two = _edge(inside.groupBy("source", F.col("b2").alias("bin")).agg(F.sum("size").alias("size"), F.max("need").alias("need")))
    two = cut(two.select("source", F.col("bin").alias("e2"), F.col("before").alias("before2")))
    last = inside.join(small(two), "source").where("b2 = e2").withColumn("need", F.col("need") - F.col("before2"))
    # What is left lies in one of sixteen million ranges of a source's ranks.
    order = Window.partitionBy("source").orderBy("x", "doc")
    ended = last.withColumn("before", F.sum("size").over(order) - F.col("size")).where(F.col("before") + F.col("size") / 2 <= F.col("need"))
    edges = cut(one.join(two, "source").join(
        ended.groupBy("source").agg(F.max(F.struct("x", "doc")).alias("stop")), "source", "left"
    ))
    chosen = ranked.join(small(edges), "source", "left")
    below = (F.col("b1") < F.col("e1")) | ((F.col("b1") == F.col("e1")) & (F.col("b2") < F.col("e2")))
    at_edge = (F.col("b1") == F.col("e1")) & (F.col("b2") == F.col("e2")) & (F.struct("x", "doc") <= F.col("stop"))
    # No edge although something is needed: rounding, all documents are taken.
    extra = F.when(~((F.col("fraction") > 0) & (F.col("need") > 0)), 0).when(F.col("e1").isNull(), 1).when(
        below | F.coalesce(at_edge, F.lit(False)), 1
    ).otherwise(0)
    return (
        chosen.withColumn("copies", F.col("whole") + extra).where("copies > 0")
        .select("source", F.col("doc").alias(doc), "size", "copies")
    )


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, docs, copies, size, share``: what each target source reached.

    Sources without documents are listed with a null target share and zeros.
    """
    got = mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("copies").alias("copies"), F.sum(F.col("size") * F.col("copies")).alias("size"),
        F.max("copies").alias("most"),
    )
    wanted = targets.select(source_key(F.col("source")).alias("source"), "weight").where("source IS NOT NULL").groupBy("source").agg(
        F.sum("weight").alias("weight")
    )
    joined = wanted.join(got, "source", "left")
    everything = Window.partitionBy(F.lit(0))
    present = F.when(F.col("docs") > 0, F.col("weight"))
    return joined.select(
        "source", (present / F.sum(present).over(everything)).alias("target_share"), F.coalesce("docs", F.lit(0)).alias("docs"),
        F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("size", F.lit(0)).alias("size"),
        (F.coalesce("size", F.lit(0)) / F.sum("size").over(everything)).alias("share"), F.coalesce("most", F.lit(0)).alias("max_copies"),
    )
