import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchmill.operators import embed, vectors
from parchmill.plans import catalog
from parchmill.plans.config import PROFILES


def tables(spark, n=300, dim=8, seed=0):
    m = np.random.RandomState(seed).randn(n, dim)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    v = spark.createDataFrame([*rows, (n, None), (n + 1, []), (n + 2, [1.0])], "vec_id long, embedding array<double>")
    return m, v, v.where(f"vec_id % 100 = 0 and vec_id < {n}").selectExpr("vec_id as qid", "embedding as qvec")


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_search_against_brute_force(spark, metric):
    m, v, q = tables(spark)
    got = vectors.search(q, v, 4, metric).orderBy("qid", "rank").collect()
    for qid in (0, 100, 200):
        s = m @ m[qid] if metric == "ip" else -((m - m[qid]) ** 2).sum(1)
        want = sorted(range(len(m)), key=lambda i: (-round(s[i], 12), i))[:4]
        assert [r["vec_id"] for r in got if r["qid"] == qid] == want


def test_blocks_of_queries(spark, monkeypatch):
    _, v, q = tables(spark)
    found = lambda: [(r["qid"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in vectors.search(q, v, 3).orderBy("qid", "rank").collect()]
    whole = found()
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)
    assert found() == whole


def test_threshold_and_empty(spark):
    _, v, q = tables(spark)
    assert all(r["score"] >= 0.3 for r in vectors.retrieve(q, v).collect())
    assert vectors.search(q.limit(0), v, 3).count() == 0
    assert vectors.search(q, v.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        vectors.search(q, v, 3, "cosine")


def test_cells_recall(spark):
    m, v, q = tables(spark, n=1000)
    ix = vectors.CellIndex(v.where("size(embedding) > 1"))
    exact = {(r["qid"], r["vec_id"]) for r in vectors.search(q, v, 5).collect()}
    found = {(r["qid"], r["vec_id"]) for r in ix.search(q, 5, probes=ix.probes).collect()}
    assert len(exact & found) / len(exact) >= 0.9
    assert ix.table.count() == 1000
    with pytest.raises(ValueError):
        vectors.CellIndex(v.limit(0))


has_tables = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="test tables are not here")


@has_tables
@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    d = f"/root/testdata/{sf}"
    exact, found = ({(r["qid"], r["vec_id"]) for r in f(spark, d).collect()} for f in (catalog.vec_topk_cosine, catalog.vec_cells))
    assert len(exact & found) / len(exact) >= 0.9


@has_tables
def test_recall_of_the_default(spark):
    v = catalog.table(spark, "/root/testdata/sf0.1", "embeddings")
    q = v.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    exact, found = ({(r["qid"], r["vec_id"]) for r in s.collect()} for s in (vectors.search(q, v, 5), vectors.CellIndex(v).search(q, 5)))
    assert len(exact & found) / len(exact) >= 0.9


def test_ties_by_key(spark):
    v = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, qvec array<double>")
    assert [r["vec_id"] for r in vectors.search(q, v, 2).orderBy("rank").collect()] == [1, 2]


@pytest.mark.parametrize("profile,default,summary,retry", [("module", (5, 0.3), (16, 0.15), (8, 0.18)), ("notebook", (8, -1.0), (16, -0.5), (11, -0.6))])
def test_routes(spark, profile, default, summary, retry):
    df = spark.createDataFrame([("what?",), ("Give a SUMMARY",), (None,)], "t string")
    rows = df.select(*(c.alias(k) for k, c in vectors.routes(F.col("t"), PROFILES[profile]).items())).collect()
    assert [(r["k"], round(r["min_score"], 4)) for r in rows] == [default, summary, default]
    assert (rows[0]["retry_k"], round(rows[0]["retry_min_score"], 4)) == retry


def test_embed(spark):
    df = spark.createDataFrame([("water rights",), ("Water rights!",), (None,), ("",), ("of " * 50_000,)], "text string")
    got = [r["embedding"] for r in embed.embed(df).collect()]
    assert got[0] == got[1] and got[2] is None and got[3] is None and abs(sum(x * x for x in got[4]) - 1) < 1e-5
    assert embed.embed(df.limit(0)).count() == 0


def test_normalize(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(vectors.normalize(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_scans_of_a_few_blocks_each(spark, monkeypatch):
    """The plan and the broadcasts do not grow with the number of queries."""
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    monkeypatch.setattr(vectors, "BLOCKS", 2, raising=False)
    monkeypatch.setattr(vectors, "TILE", 7, raising=False)
    rng = np.random.RandomState(3)
    m = rng.randint(-2, 3, (60, 4)).astype(float)  # many ties
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "vec_id long, embedding array<float>")
    q = v.where("vec_id < 25").selectExpr("vec_id as qid", "embedding as qvec")
    for metric in ("ip", "l2"):
        out = vectors.search(q, v, 5, metric)
        got = {}
        for r in out.orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append(r["vec_id"])
        cost = -(m[:25] @ m.T) if metric == "ip" else ((m[:25, None] - m[None]) ** 2).sum(2)
        assert got == {i: np.lexsort((np.arange(60), c))[:5].tolist() for i, c in enumerate(cost)}
        assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") <= 1


def test_estimates_lose_no_vector():
    """Scores that single precision cannot tell apart, of any length, with own bounds."""
    rng = np.random.default_rng(3)
    for scale in (1.0, 1e-20, 1e20, 1e-9):
        m = rng.normal(size=(700, 24)) * scale
        m[300:600] = m[:300] * (1 + 1e-9 * rng.normal(size=(300, 1)))
        m[600:650], m[650:] = m[:50], 0
        q = rng.normal(size=(40, 24))
        exact = np.round(q @ m.T, 12)
        for floor, depth in ((None, None), (np.full(40, 0.5 * scale), rng.integers(1, 9, 40))):
            b = vectors._Best(list(range(40)), q, 8, "ip", floor, depth)
            for a in range(0, 700, 64):
                b.add(np.arange(40), np.arange(a, min(a + 64, 700)), m[a : a + 64], vectors._lengths(m[a : a + 64]))
            got = {(int(r), int(c)) for r, c, _ in zip(*b.rows())}
            want = set()
            for i in range(40):
                order = [c for c in np.lexsort((np.arange(700), -exact[i])) if floor is None or exact[i, c] >= floor[i]]
                want |= {(i, int(c)) for c in order[: 8 if depth is None else depth[i]]}
            assert want <= got and len(got) <= 40 * 8


def test_vectors_are_written_once(spark, monkeypatch):
    """With more queries than a scan takes, an embedder below runs once for each vector."""
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 4)
    monkeypatch.setattr(vectors, "BLOCKS", 2)
    runs = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<double>")
    def made(k):
        runs.add(len(k))
        return k.map(lambda i: [float(i % 7), float(i % 5), 1.0])

    v = spark.range(50).select(F.col("id").alias("vec_id")).withColumn("embedding", made("vec_id"))
    q = spark.createDataFrame([(i, [float(i), 1.0, -1.0]) for i in range(30)], "qid long, qvec array<double>")
    assert vectors.search(q, v, 3).count() == 90 and runs.value == 50
