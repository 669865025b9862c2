"""Held-out test items inside a training corpus, by a positional inverted index.

Method. The corpus is tokenized once and stored as the terms of each document in their places (a term is the
64-bit hash of a word). Term frequencies of the items' vocabulary are counted over all of it. Every window of
``run`` consecutive item words is represented by its rarest terms, and only the postings (term, document,
position) of those are drawn from the store. Positions less the term's offset in the item give the place where
the item would begin; lists so adjusted are intersected per (document, item, place). What remains is compared
term for term in the store. Frequent words never leave the scan, unless a window holds nothing rarer.
"""

from __future__ import annotations

import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.session import cut, ship, small, written

RUN = 12
#: Anchor terms a window is looked up by.
ANCHORS = 3


def _accents() -> tuple[str, str]:
    """Small letters with a canonical decomposition and their base letters, and ``ł``."""
    pairs = {"ł": "l"}
    for code in range(0xC0, 0xFFFF):
        if 0x3400 <= code <= 0xF8FF:
            continue
        ch = chr(code)
        base = unicodedata.normalize("NFD", ch)
        if base != ch and len(base) > 1 and unicodedata.category(ch).startswith("L") and unicodedata.category(base[0]).startswith("L"):
            pairs[ch] = base[0]
    return "".join(pairs), "".join(pairs.values())


_FROM, _TO = _accents()


def words(text: Column) -> Column:
    """Words of a text: maximal runs of letters and digits, without case, diacritics and invisible signs.

    JVM expressions only. Null gives null, a text without words an empty array.
    """
    bare = F.regexp_replace(F.translate(F.lower(text), _FROM, _TO), r"[\p{M}\p{Cf}]+", "")
    return F.filter(F.split(bare, r"[^\p{L}\p{Nd}]+"), lambda w: w != "")


def terms_of(text: Column) -> Column:
    """The words of a text as 64-bit hashes, which are compared in their stead."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def stored_terms(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, terms``: the terms of every document in their places, written once for all passes over them.

    Null texts are left out; a repeated key keeps its different texts.
    """
    return written(documents.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{doc}`").alias("doc"), terms_of(F.col(f"`{text}`")).alias("terms")))


def _listed(items: DataFrame, item: str, text: str) -> DataFrame:
    """``item, item_words``: the terms of each item, equal ones once."""
    return items.where(F.col(f"`{item}`").isNotNull()).select(F.col(f"`{item}`").alias("item"), terms_of(F.col(f"`{text}`")).alias("item_words")).distinct()


def _frequency(store: DataFrame, listed: DataFrame) -> DataFrame:
    """``term, n`` of the items' terms over all documents, combined in each task before they are shuffled."""
    vocabulary = small(cut(listed.select(F.explode("item_words").alias("term")).distinct()))
    return cut(store.select(F.explode("terms").alias("term")).join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n")))


def _postings(store: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, doc, pos`` of the given terms, one row per occurrence in the corpus."""
    return store.select("doc", F.posexplode("terms").alias("pos", "term")).join(small(terms), "term", "left_semi")


def leaked(
    documents: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", run: int = RUN
) -> DataFrame:
    """``doc, item, place, longest``: documents that hold at least ``run`` consecutive words of an item.

    One row for each place (the word of the document at which the item would begin; negative where
    the beginning is cut off) with the length of the longest run there. Items of fewer words than
    ``run``, and null or empty texts on either side, match nothing; repeated rows count once.
    """
    ship(documents.sparkSession)
    store = stored_terms(documents, doc, text)
    listed = cut(_listed(items, item, text).where(F.size("item_words") >= run))
    frequency = _frequency(store, listed)
    at = listed.select("item", F.posexplode("item_words").alias("off", "term")).join(frequency, "term", "left").fillna(0, ["n"])
    window = listed.select("item", F.explode(F.expr(f"sequence(0, size(item_words) - {run})")).alias("start"))
    near = window.join(at, "item").where((F.col("off") >= F.col("start")) & (F.col("off") < F.col("start") + run))
    rarest = Window.partitionBy("item", "start").orderBy("n", "off")
    anchor = near.withColumn("r", F.row_number().over(rarest)).where(F.col("r") <= ANCHORS)
    # A window with a word that the corpus lacks cannot be in it.
    possible = anchor.groupBy("item", "start").agg(F.min("n").alias("least"), F.array_sort(F.collect_list("off")).alias("offs"))
    needed = possible.where("least > 0").select("item", "offs").distinct()
    probes = needed.select("item", F.explode("offs").alias("off")).distinct().join(at.select("item", "off", "term"), ["item", "off"])
    probes = small(cut(probes))
    postings = _postings(store, probes.select("term").distinct())
    places = (
        postings.join(probes, "term")
        .groupBy("doc", "item", (F.col("pos") - F.col("off")).alias("place"))
        .agg(F.collect_set("off").alias("found"))
        .where(F.size("found") >= min(ANCHORS, run))
    )
    wanted = needed.groupBy("item").agg(F.collect_list("offs").alias("wanted"))
    candidates = cut(
        places.join(small(cut(wanted)), "item")
        .where(F.exists("wanted", lambda offs: F.size(F.array_except(offs, F.col("found"))) == 0))
        .select("doc", "item", "place")
    )
    # The exact comparison, on the stretch of the document where the item would be.
    begin, length = F.greatest("place", F.lit(0)), F.size("item_words")
    stretch = store.join(small(candidates), "doc").join(small(listed), "item").select(
        "doc", "item", "place", "item_words", F.slice("terms", begin + 1, length).alias("there"), (begin - F.col("place")).alias("skipped"),
    )
    equal = F.zip_with(
        F.slice("item_words", F.col("skipped") + 1, length), F.col("there"), lambda a, b: F.coalesce(a == b, F.lit(False))
    )
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(acc: Column, same: Column) -> Column:
        now = F.when(same, acc["now"] + 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["best"], now).alias("best"))

    longest = F.aggregate(equal, start, step, lambda acc: acc["best"])
    found = stretch.select("doc", "item", "place", longest.alias("longest")).where(F.col("longest") >= run)
    return found.groupBy("doc", "item", "place").agg(F.max("longest").alias("longest")).select(
        F.col("doc").alias(doc), F.col("item").alias(item), "place", "longest"
    )


@F.pandas_udf(T.StructType([T.StructField("terms", T.LongType()), T.StructField("span", T.LongType())]))
def _in_place(item_words: pd.Series, there: pd.Series, shifts: pd.Series) -> pd.DataFrame:
    """How many words of an item stand in a stretch within so many shifts of their places, and minus their spread."""
    out = []
    for item, stretch, width in zip(item_words, there, shifts):
        at: dict[int, list[int]] = {}
        for i, word in enumerate(stretch):
            if word:
                at.setdefault(word, []).append(i)
        held = [own for off, word in enumerate(item) if (own := [i - off for i in at.get(word, ()) if 0 <= i - off < width])]
        if not held:
            out.append((0, 0))
            continue
        count = Counter(x for own in held for x in own)
        usual = min(count, key=lambda x: (-count[x], x))
        nearest = [min(own, key=lambda x: (abs(x - usual), x)) for own in held]
        out.append((len(held), min(nearest) - max(nearest)))
    return pd.DataFrame(out, columns=["terms", "span"])


def near_items(
    documents: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text",
    share: float = 0.8, slop: int = 12, hits: int = 3,
) -> DataFrame:
    """``doc, item, terms, span``: proximity matches, which find items that were edited.

    A document matches where at least ``share`` of all the item's words, and four at least, stand close
    to their places in the item: shifted against each other by less than ``slop`` words, or by up to
    twice as many where they fall into the same two cells. ``terms`` is the number of words in place
    where most are, ``span`` the shift between the extremes there, of each word the shift nearest to
    the commonest. Words that the corpus lacks count as not in place. Nulls and empty texts match nothing.

    The rarest words only say where to look. A match lacks at most ``size - need`` words, so at least
    ``hits`` of the ``size - need + hits`` rarest are in place: no match is missed. There all words are counted.
    """
    ship(documents.sparkSession)
    store = stored_terms(documents, doc, text)
    listed = _listed(items, item, text)
    need = F.greatest(F.lit(4), F.ceil(F.round(F.size("item_words") * F.lit(share), 9))).cast("int")
    listed = listed.withColumn("need", need).where(F.size("item_words") >= F.col("need"))
    # A number for each text, fixed by the cut, so that several texts under one key are looked for one by one.
    listed = cut(listed.withColumn("it", F.monotonically_increasing_id()))
    frequency = _frequency(store, listed)
    at = listed.select("it", "need", F.size("item_words").alias("size"), F.posexplode("item_words").alias("off", "term")).join(frequency, "term", "left").fillna(0, ["n"])
    order = Window.partitionBy("it").orderBy("n", "off")
    least = F.least(F.lit(hits), F.col("need"))
    looked = F.col("size") - F.col("need") + least
    probes = at.withColumn("r", F.row_number().over(order)).where(F.col("r") <= looked).where("n > 0")
    probes = small(cut(probes.select("it", "off", "term", least.alias("least"))))
    postings = _postings(store, probes.select("term").distinct())
    place = F.col("pos") - F.col("off")
    cell = F.floor(place / slop)
    # Cells of width slop, each place in its own and the next: places less than slop apart share one.
    spread = postings.join(probes, "term").select("doc", "it", "least", "off", F.explode(F.array(cell, cell + 1)).alias("cell"))
    groups = spread.groupBy("doc", "it", "cell").agg(F.count_distinct("off").alias("found"), F.first("least").alias("least"))
    candidates = cut(groups.where(F.col("found") >= F.col("least")).select("doc", "it", "cell"))
    # The stretch holds the places of the cell before and of this one; what lies before the document is 0, no term.
    begin, length = (F.col("cell") - 1) * slop, F.size("item_words") + 2 * slop
    before = F.least(F.greatest(-begin, F.lit(0)), length).cast("int")
    stretch = store.join(small(candidates), "doc").join(small(listed), "it").select(
        "doc", "item", "item_words", "need",
        F.concat(
            F.array_repeat(F.lit(0).cast("long"), before),
            F.slice("terms", F.greatest(begin, F.lit(0)).cast("int") + 1, length - before),
        ).alias("there"),
    )
    counted = stretch.select("doc", "item", "need", _in_place("item_words", "there", F.lit(2 * slop)).alias("b"))
    kept = counted.where(F.col("b.terms") >= F.col("need"))
    best = kept.groupBy("doc", "item").agg(F.max("b").alias("b"))
    return best.select(F.col("doc").alias(doc), F.col("item").alias(item), "b.terms", (-F.col("b.span")).alias("span"))
