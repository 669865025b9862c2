"""Long spans that stand verbatim in more than one record.

Method: compact windows. A text is a sequence of overlapping tokens (runs of characters, five sixths of
the span looked for); a hash function gives every token a value. In the Cartesian tree over these values every
node is the minimum of all token ranges that contain it and stay within its subtree: a compact window (left,
centre, right). Windows as long as the token range of a span of ``least`` characters are kept, about two per
span length of text. Texts that share such a span share the token at the centre of a window in each, under
every hash function; windows are joined on that token where their ranges, laid over each other, still
hold a span. What stands around the two centres is then compared character by character.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statuta.session import cut, hot_join, ship, small, written

LEAST = 300
#: Hash functions under which a shared span must show. Every span shows under one; further ones only thin out what is
#: compared in the end, which the length of the tokens has done already.
HASHES = 1
#: Windows of one token value that meet all others of it in one task.
MEETING = 1024


def gram_of(least: int) -> int:
    """Characters of a token: nearly a span, so that stock phrases shorter than that join nothing."""
    return max(1, least * 5 // 6)


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(values: np.ndarray, seed: int) -> np.ndarray:
    """A hash function of 64-bit values (a published finalizer with a seed)."""
    z = values + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def gram_values(codes: np.ndarray, gram: int) -> np.ndarray:
    """A value for every run of ``gram`` characters; equal runs have equal values."""
    if len(codes) < gram:
        return np.zeros(0, np.uint64)
    n = len(codes)
    weighted = (codes.astype(np.uint64) + np.uint64(1)) * _powers(_INVERSE, n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weighted, dtype=np.uint64)])
    return (total[gram:] - total[:-gram]) * _powers(_BASE, n)[: n - gram + 1]


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` values the place of its minimum, the leftmost of equals.

    Values are ordered by their upper 32 bits; the lower ones give way to the place, so that a
    minimum carries its place. Equal texts stay in the same order, whatever surrounds them.
    """
    n = len(values)
    count = n - width + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    keyed = (values & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    blocks = np.concatenate([keyed, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    # The minimum of a window is that of the end of one block and of the beginning of the next.
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def compact_windows(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, centre, right) of the compact windows of at least ``width`` tokens.

    They are the nodes of the Cartesian tree (leftmost minimum on top) whose subtree spans ``width`` or
    more: the minima of sliding windows, each with the ranges it is the minimum of. Ranges are clipped to
    ``width - 1`` on either side of the centre, which holds every window of ``width`` around it.
    """
    centre = leftmost_minima(values, width)
    if not len(centre):
        return centre, centre, centre
    first = np.nonzero(np.concatenate([[True], centre[1:] != centre[:-1]]))[0]
    last = np.concatenate([first[1:], [len(centre)]]) - 1
    return first, centre[first], last + width - 1


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


_WINDOWS = "doc long, seed int, value long, before int, centre int, after int"


def _windows(least: int, gram: int, hashes: int):
    width = least - gram + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for doc, text in zip(batch["doc"], batch["text"]):
                if text is None or len(text) < least:
                    continue
                base = gram_values(_codes(text), gram)
                for seed in range(hashes):
                    values = _mixed(base, seed)
                    left, centre, right = compact_windows(values, width)
                    parts.append((np.full(len(left), doc), np.full(len(left), seed), values[centre].view(np.int64), centre - left, centre, right - centre))
            if parts:
                yield pd.DataFrame(dict(zip(("doc", "seed", "value", "before", "centre", "after"), map(np.concatenate, zip(*parts)))))

    return run


_RUNS = "doc_a long, doc_b long, start_a int, length int"


def _grid(texts: pd.Series, width: int, pad: str, turned: bool) -> np.ndarray:
    """Characters of short texts as rows of a matrix, turned round if wanted; ``pad`` stands where a text has none."""
    rows = (t[::-1] if turned else t for t in texts)
    return _codes("".join(t.ljust(width, pad) for t in rows)).reshape(len(texts), width)


def _verify(least: int, gram: int):
    """How far the texts around two equal tokens agree: runs that hold both tokens and ``least`` characters."""
    room = least - gram

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            reach = []
            for side, turned in (("l", True), ("r", False)):
                # What stands for a missing character differs on the two sides, and from any character.
                same = _grid(batch[f"{side}_a"], room, "\ue000", turned) == _grid(batch[f"{side}_b"], room, "\ue001", turned) if room else np.zeros((len(batch), 0), bool)
                inside = np.arange(room)[None, :] < np.minimum(batch[f"{side}_a"].str.len(), batch[f"{side}_b"].str.len()).to_numpy(np.int64)[:, None]
                reach.append(np.cumprod(same & inside, axis=1).sum(axis=1))
            kept = (reach[0] + reach[1] + gram >= least) & (batch["t_a"] == batch["t_b"]).to_numpy(bool)
            found = batch[kept]
            yield pd.DataFrame({
                "doc_a": found["doc_a"], "doc_b": found["doc_b"], "start_a": found["centre_a"] - reach[0][kept], "length": gram + (reach[0] + reach[1])[kept],
            })

    return run


def classes(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, rep, n_chars``: each document with the least key among those of equal text; null texts and keys are left out.

    A key repeated with different texts is in the class of each of them.
    """
    hashed = documents.where(F.col(f"`{text}`").isNotNull() & F.col(f"`{doc}`").isNotNull()).select(
        F.col(f"`{doc}`").cast("long").alias("doc"), F.sha2(F.col(f"`{text}`"), 256).alias("h"), F.length(F.col(f"`{text}`")).cast("long").alias("n_chars")
    )
    reps = hashed.groupBy("h").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("n"))
    # Most texts are their own class; those of a popular text are spread.
    several = hot_join(hashed, cut(reps.where("n > 1").drop("n")), ["h"], ["doc"])
    return several.select(F.col("doc").alias(doc), F.coalesce("rep", "doc").alias("rep"), "n_chars").distinct()


def representative_runs(
    documents: DataFrame, doc: str = "doc_id", text: str = "text", least: int = LEAST, hashes: int = HASHES, both: bool = False
) -> DataFrame:
    """``doc_a, doc_b, start_a, length``: runs of ``doc_a`` that stand in ``doc_b`` as well, of different texts.

    One document stands for all of equal text. ``doc_a < doc_b``, unless ``both`` directions are asked for. Runs
    are of at least ``least`` characters; a longer one comes in pieces that overlap and cover it. A passage of many
    texts is met in parts of MEETING windows, and one that a text repeats is compared once with another text.
    """
    ship(documents.sparkSession)
    gram = gram_of(least)
    keyed = documents.where(F.col(f"`{text}`").isNotNull() & F.col(f"`{doc}`").isNotNull() & (F.length(F.col(f"`{text}`")) >= least)).select(
        F.col(f"`{doc}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"), F.sha2(F.col(f"`{text}`"), 256).alias("h")
    )
    # Of a repeated key with different texts the one with the least hash counts.
    keys = keyed.groupBy("doc").agg(F.min("h").alias("h"), F.count(F.lit(1)).alias("n"))
    firsts = cut(keys.groupBy("h").agg(F.min("doc").alias("doc"), F.max("n").alias("n")))
    texts = keyed.join(small(firsts.drop("n")), ["doc", "h"], "left_semi").select("doc", "text")
    if not firsts.where("n > 1").isEmpty():
        texts = texts.dropDuplicates(["doc"])  # rows that stand several times; without them no text is shuffled
    windows = written(texts.mapInPandas(_windows(least, gram, hashes), _WINDOWS))
    # Values of one document only are gone before the join: they are the bulk. Counts are combined before they are shuffled.
    shared = cut(
        windows.groupBy("seed", "value").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi")
        .select("seed", "value", F.ceil(F.col("n") / MEETING).cast("int").alias("parts"))
    )
    met = small(cut(hot_join(windows, shared, ["seed", "value"], ["doc"], "inner")))
    # Only what stands around a shared token leaves its text.
    room, at = least - gram, F.col("centre")
    slices = cut(
        texts.join(met, "doc").select(
            "doc", "seed", "value", "parts", "before", "centre", "after", F.substring("text", at + 1, F.lit(gram)).alias("t"),
            F.substring("text", F.greatest(at - room, F.lit(0)) + 1, F.least(at, F.lit(room))).alias("l"), F.substring("text", at + gram + 1, F.lit(room)).alias("r"),
        )
    )
    around = ["doc", "before", "after", "t", "l", "r"]
    a = slices.select("seed", "value", F.pmod(F.xxhash64("doc"), "parts").cast("int").alias("part"), F.col("centre").alias("centre_a"), *[F.col(c).alias(f"{c}_a") for c in around])
    b = slices.select("seed", "value", "parts", *[F.col(c).alias(f"{c}_b") for c in around]).distinct()
    b = b.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    overlap = F.least("before_a", "before_b") + F.least("after_a", "after_b") + 1 >= least - gram + 1
    pairs = a.join(b, ["seed", "value", "part"]).where(F.col("doc_a") != F.col("doc_b") if both else F.col("doc_a") < F.col("doc_b")).where(overlap)
    return pairs.select("doc_a", "doc_b", "centre_a", "t_a", "t_b", "l_a", "l_b", "r_a", "r_b").mapInPandas(_verify(least, gram), _RUNS)


def shared_pairs(documents: DataFrame, doc: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``doc_a, doc_b`` (smaller first): documents that share a span of at least ``least`` characters.

    Different texts are linked through their representatives (least keys), and every copy is linked to
    the other side's representative and to its own, so that rows grow with the copies and not with
    their square. Null and shorter texts have no pair.
    """
    runs = representative_runs(documents, doc, text, least).select("doc_a", "doc_b").distinct()
    member = classes(documents, doc, text).withColumnRenamed(doc, "doc").where(F.col("n_chars") >= least)
    copies = member.where("doc != rep").select("doc", "rep")
    own = copies.select(F.col("rep").alias("doc_a"), F.col("doc").alias("doc_b"))
    left = runs.join(copies, F.col("doc_a") == F.col("rep")).select(F.col("doc").alias("x"), F.col("doc_b").alias("y"))
    right = runs.join(copies, F.col("doc_b") == F.col("rep")).select(F.col("doc_a").alias("x"), F.col("doc").alias("y"))
    crossed = left.unionByName(right).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
    return reduce(DataFrame.unionByName, [runs, own, crossed]).distinct()


def coverage(documents: DataFrame, doc: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``doc, n_chars, shared_chars, n_linked``: how much of each document stands elsewhere as well.

    ``shared_chars`` counts the characters inside spans of at least ``least`` characters that occur in
    another document; all of them where the whole text has a copy. ``n_linked`` counts the other
    texts, copies once. Documents with a null text have zeros; repeated keys count once.
    """
    runs = representative_runs(documents, doc, text, least, both=True)
    sides = cut(runs.select(F.col("doc_a").alias("rep"), F.col("doc_b").alias("other"), F.col("start_a").alias("s"), (F.col("start_a") + F.col("length")).alias("e")).distinct())
    linked = sides.groupBy("rep").agg(F.count_distinct("other").alias("n_linked"))
    # A popular passage is the same stretch in many pairs, and a long one comes in pieces: equal ones are merged before sorting.
    stretches = sides.select("rep", "s", "e").distinct()
    order = Window.partitionBy("rep").orderBy("s", "e")
    reached = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gain = F.greatest(F.lit(0), F.col("e") - F.greatest("s", F.coalesce("reached", F.lit(0))))
    covered = stretches.withColumn("reached", reached).groupBy("rep").agg(F.sum(gain).alias("covered"))
    member = cut(classes(documents, doc, text).withColumnRenamed(doc, "doc").withColumnRenamed("n_chars", "size"))
    copies = member.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    joined = member.join(copies, "rep").join(covered, "rep", "left").join(linked, "rep", "left")
    shared = F.when((F.col("n") > 1) & (F.col("size") >= least), F.col("size")).otherwise(F.coalesce("covered", F.lit(0)))
    known = joined.groupBy("doc").agg(F.max(shared).alias("shared"), F.max(F.coalesce("n_linked", F.lit(0))).alias("linked"))
    every = documents.where(F.col(f"`{doc}`").isNotNull()).groupBy(F.col(f"`{doc}`").cast("long").alias("doc")).agg(
        F.max(F.coalesce(F.length(F.col(f"`{text}`")), F.lit(0))).alias("n_chars")
    )
    return every.join(known, "doc", "left").select(
        F.col("doc").alias(doc), "n_chars", F.coalesce("shared", F.lit(0)).alias("shared_chars"), F.coalesce("linked", F.lit(0)).alias("n_linked")
    )
