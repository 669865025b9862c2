"""Leaked items against brute force over all runs of words."""

import random
import unicodedata

from pyspark.sql import functions as F

from statuta.llm import leakage as L


def words(text):
    text = "".join(c for c in unicodedata.normalize("NFD", text.lower()).replace("ł", "l") if unicodedata.category(c) not in ("Mn", "Mc", "Me", "Cf"))
    out, now = [], ""
    for c in text + " ":
        if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd":
            now += c
        elif now:
            out.append(now)
            now = ""
    return out


def test_words(spark):
    texts = ["Żółć, GĘŚ-12 a­b", "żółć", "x​y", "", "...", None, "Łódź naïve Ångström"]
    got = [r.w for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(L.words(F.col("t")).alias("w")).collect()]
    assert got == [None if t is None else words(t) for t in texts]


def test_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"słowo{i}" for i in range(40)] + ["i", "w", "na"] * 5
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 30)))) for i in range(25)] + [(90, None), (91, ""), (92, "na " * 20), (None, "x " * 20)]
    items.append(items[0])
    docs = []
    for d in range(120):
        parts = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        if rng.random() < 0.6:
            source = rng.choice(items[:25])[1].split()
            a = rng.randrange(len(source))
            cut = source[a : a + rng.choice([8, 11, 12, 13, 30])]
            at = rng.randrange(len(parts) + 1)
            parts[at:at] = [w.upper() if rng.random() < 0.3 else w + "," if rng.random() < 0.2 else w for w in cut]
        docs.append((d, " ".join(parts)))
    docs += [(500, None), (501, ""), (502, "NA, " * 40), docs[0]]
    exp, runs = set(), {}
    for i, t in items:
        if t and i is not None:
            w = words(t)
            for a in range(len(w) - 11):
                runs.setdefault(tuple(w[a : a + 12]), set()).add(i)
    for d, t in docs:
        w = words(t or "")
        for a in range(len(w) - 11):
            exp |= {(d, i) for i in runs.get(tuple(w[a : a + 12]), ())}
    documents = spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit("x")).withColumn("pos", F.lit(1))
    found = L.leaked(documents, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == exp and (502, 92) in exp and len(exp) > 10
    assert L.leaked(documents.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert L.leaked(documents, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_proximity(spark):
    item = "alfa beta gamma delta epsilon zeta eta theta jota kappa lambda mi"
    edited = "alfa beta gamma NOWE delta epsilon zeta theta jota INNE kappa lambda mi"
    docs = spark.createDataFrame([(1, "x " * 50 + edited + " y" * 50), (2, "alfa " + "x " * 40 + "beta"), (3, None)], "doc_id long, text string")
    got = L.near_items(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.terms) for r in got] == [(1, 7, 11)]


def near(doc, item, share=0.8, slop=12):
    """Most words in place in any two cells, and minus their spread; None if too few."""
    d, w = words(doc), words(item)
    at = [(p - o, o) for o, x in enumerate(w) for p, y in enumerate(d) if x == y]
    best = None
    for cell in {p // slop + k for p, _ in at for k in (0, 1)}:
        inside = [(p, o) for p, o in at if p // slop in (cell - 1, cell)]
        places = sorted(p for p, _ in inside)
        usual = max(places, key=lambda p: (places.count(p), -p))
        near = {o: min((p for p, x in inside if x == o), key=lambda p: (abs(p - usual), p)) for _, o in inside}
        best = max(best or (0, 0), (len(near), min(near.values()) - max(near.values())))
    return best if best and best[0] >= max(4, -(-len(w) * int(share * 10) // 10)) else None


def test_proximity_counts_all_words(spark):
    rare = [f"rzadkie{i}" for i in range(12)]
    common = ["i", "w", "na", "z", "do", "od", "po", "za", "dla", "oraz", "albo", "lecz", "jest", "tak", "nie", "co"]
    item = " ".join(x for pair in zip(rare, common) for x in pair) + " tu tam"
    edited = item
    for i in range(4):
        edited = edited.replace(f"rzadkie{i} ", f"inne{i} ")
    docs = [(1, edited), (2, "x " * 30 + edited), (3, " ".join(common)), (4, " ".join(rare)), *((10 + i, " ".join(common) + " tu tam") for i in range(8))]
    got = L.near_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    n = len(words(item))
    # Four of the twelve rarest words were replaced, and yet over 80 % of all words are in place.
    assert n - 4 >= 0.8 * n and {(r.doc_id, r.item_id, r.terms) for r in got} == {(1, 7, n - 4), (2, 7, n - 4)}


def test_proximity_by_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"s{i}" for i in range(60)] + ["i", "w"] * 8
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 36)))) for i in range(20)]
    docs = []
    for d in range(120):
        w = rng.choice(items)[1].split()
        for _ in range(rng.randrange(9)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randrange(2)] = [rng.choice(["nowe", *vocabulary]) for _ in range(rng.randrange(3))]
        docs.append((d, " ".join([rng.choice(vocabulary) for _ in range(rng.randrange(40))] + w + [rng.choice(vocabulary)] * rng.randrange(20))))
    exp = {(d, i, b[0], -b[1]) for d, t in docs for i, x in items if (b := near(t, x))}
    got = L.near_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.terms, r.span) for r in got} == exp and len(got) == len(exp) > 40
