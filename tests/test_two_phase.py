"""What two_phase_means computes once, and how a popular act is spread."""

from pyspark.sql import functions as F

from statuta.operators import vector as V
from statuta.queries import evaluation as Q


def test_similar_questions_are_searched_once_for_both_filters(spark, small, monkeypatch):
    calls, found_sets = [], Q.E.found_sets
    monkeypatch.setattr(Q.E, "found_sets", lambda *a: (calls.append(1), found_sets(*a))[1])
    assert Q.two_phase_means(spark, small).count() == 2
    assert len(calls) == 1


def test_a_popular_act_does_not_copy_many_queries(spark, monkeypatch):
    # Each block of rows copies all queries of the act and gives k hits to each: with many queries there are few.
    monkeypatch.setattr(V, "PART", 8)
    monkeypatch.setattr(V, "BLOCK", 100)
    seen, block_topk = [], V._block_topk
    monkeypatch.setattr(V, "_block_topk", lambda *a: (seen.append(1), block_topk(*a))[1])
    rng = V.np.random.default_rng(3)
    row = lambda i: (i, 7, [float(x) for x in rng.normal(size=64)])
    corpus = spark.createDataFrame([row(i) for i in range(150)], "id long, act long, vector array<float>")
    queries = spark.createDataFrame([row(i) for i in range(120)], "qid long, act long, vector array<float>")
    parts = spark.range(1).select(V._row_blocks(F.lit(150), F.lit(120)).alias("b")).first().b
    assert parts == 2
    got = V.filtered_topk(queries.select("qid", "vector"), queries.select("qid", "act"), corpus, 3)
    rows = {r.qid: [] for r in queries.collect()}
    for r in got.orderBy("qid", "rank").collect():
        rows[r.qid].append(r.id)
    unit = lambda df: (lambda m: m / V.np.linalg.norm(m, axis=1, keepdims=True))(V.np.array([r.vector for r in df.collect()]))
    s = V.np.round(unit(queries.orderBy("qid")) @ unit(corpus.orderBy("id")).T, 9)
    assert rows == {i: [int(j) for j in V.np.argsort(-s[i], kind="stable")[:3]] for i in range(120)}
    assert seen == [1]
