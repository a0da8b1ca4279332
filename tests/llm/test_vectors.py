"""Vector searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from contentgrade.llm import ann, topk
from contentgrade.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, score string"


def rows_of(vectors):
    return [(i, [float(x) for x in v], "x") for i, v in enumerate(vectors)]


ODD = [
    (5000, None, "x"),
    (5001, [], "x"),
    (5002, [float("nan")] * 8, "x"),
    (5003, [float("inf")] + [0.0] * 7, "x"),
    (5004, [None] + [0.0] * 7, "x"),
    (5005, [1.0] * 3, "x"),
    (None, [1.0] * 8, "x"),
]


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(3)
    v = r.normal(size=(700, 8)).astype(np.float32)
    v[100:260] = v[0]
    v[300:320] *= 20
    return v


def brute(matrix, ids, queries, k):
    out = {}
    for q in queries:
        scores = matrix @ matrix[q]
        scores = np.where(np.arange(len(ids)) == q, -np.inf, scores)
        best = np.lexsort((ids, -scores))[: min(k, len(ids) - 1)]
        out[int(ids[q])] = [(int(ids[b]), scores[b]) for b in best]
    return out


def by_query(found):
    out = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("part", [100_000, 64])
def test_nearest_neighbours(spark, vectors, monkeypatch, part):
    monkeypatch.setattr(ann, "PART_ROWS", part)
    monkeypatch.setattr(ann, "QUERY_ROWS", part)
    rows = rows_of(vectors) + ODD + [(6000, [0.0] * 8, "x"), (20, [float(x) for x in vectors[20]], "x")]
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = by_query(ann.nearest_neighbours(table, F.col("vec_id") % 20 == 0).collect())
    matrix = vectors.astype(float)
    expected = brute(matrix, np.arange(700), range(0, 700, 20), 20)
    assert found.keys() == expected.keys()
    hits = 0
    for q, best in expected.items():
        assert len(found[q]) == 20
        assert found[q] == sorted(found[q], key=lambda x: (-x[1], x[0]))
        for vec_id, score in found[q]:
            assert vec_id != q and score == pytest.approx(matrix[vec_id] @ matrix[q], rel=1e-12, abs=1e-12)
        hits += len({v for v, _ in found[q]} & {v for v, _ in best})
    assert hits >= 0.9 * 20 * len(expected)
    # Of many equal vectors those of the smallest ids come first.
    ties = [v for v, _ in found[100] if v == 0 or 100 <= v < 260]
    assert ties == sorted(ties)


def test_graph_search_finds_what_sorting_finds():
    r = np.random.default_rng(1)
    sample = np.vstack([r.normal(c, 0.3, size=(400, 6)) for c in r.normal(0, 3, size=(10, 6))])
    fitted = ann.fit_centroids(sample, 20_000, float(np.linalg.norm(sample, axis=1).max()))
    asked = fitted.lifted(sample[:200], False)
    ids, far = fitted.nearest(asked, 64)
    exact = np.sqrt(((asked[:, None, :] - fitted.points[None]) ** 2).sum(axis=2))
    best = np.argsort(exact, axis=1)[:, :16]
    hits = [len(set(a[:16]) & set(b)) for a, b in zip(ids, best, strict=True)]
    assert np.mean(hits) > 15.5 and (np.diff(far, axis=1) >= 0).all()


def test_few_or_no_vectors(spark):
    table = spark.createDataFrame(rows_of(np.eye(8)[:3]) + ODD, SCHEMA)
    assert {q: len(f) for q, f in by_query(ann.nearest_neighbours(table, F.lit(True)).collect()).items()} == {0: 2, 1: 2, 2: 2}
    assert {q: len(f) for q, f in by_query(topk.top_k(table, F.lit(True)).collect()).items()} == {0: 2, 1: 2, 2: 2}
    for rows in ([], ODD, rows_of(np.eye(8)[:1])):
        table = spark.createDataFrame(rows, SCHEMA)
        assert ann.nearest_neighbours(table, F.col("vec_id") % 20 == 0).collect() == []
        assert topk.top_k(table, F.col("vec_id") % 20 == 0).collect() == []


@pytest.mark.parametrize("query_set,block", [(100_000, 100_000), (10, 50)])
def test_top_k_is_exact(spark, vectors, monkeypatch, query_set, block):
    monkeypatch.setattr(topk, "QUERY_SET", query_set)
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    rows = rows_of(vectors) + ODD + [(6000, [0.0] * 8, "x"), (20, [float(x) for x in vectors[20]], "x")]
    found = by_query(topk.top_k(spark.createDataFrame(rows, SCHEMA).repartition(4), F.col("vec_id") % 20 == 0).collect())
    matrix = np.vstack([np.floor(1024 * vectors.astype(float)), np.zeros((1, 8))])
    expected = brute(matrix, np.append(np.arange(700), 6000), [*range(0, 700, 20), 700], 10)
    assert found == {q: [(v, int(s)) for v, s in best] for q, best in expected.items()}


def test_large_components_stay_exact():
    r = np.random.default_rng(5)
    data = r.integers(-(2**26), 2**26, size=(300, 8)).astype(float)
    dual = topk.DualSearch(data[:20], np.arange(20), np.zeros(20, dtype=np.int64), 5)
    dual.add(data, np.arange(300), np.zeros(300, dtype=np.int64))
    for q in range(20):
        scores = [sum(int(a) * int(b) for a, b in zip(data[q], row, strict=True)) for row in data]
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-scores[i], i))[:5]
        assert dual.found[q][:, 0].tolist() == best and dual.scores[q].tolist() == [scores[i] for i in best]


def test_vectors_of_large_components_take_part(spark):
    r = np.random.default_rng(9)
    v = r.normal(size=(120, 4)).astype(np.float32)
    v[40, 0], v[60, 1], v[77, 2] = 200_000.0, -3.0e8, 3.0e12
    table = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<float>")
    found = by_query(topk.top_k(table, F.col("vec_id") % 20 == 0).collect())
    ints = [[int(np.floor(1024 * float(x))) for x in row] for row in v]
    for q in range(0, 120, 20):
        scores = [max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(ints[q], row, strict=True)))) for row in ints]
        best = sorted((i for i in range(120) if i != q), key=lambda i: (-scores[i], i))[:10]
        assert found[q] == [(i, scores[i]) for i in best]


@pytest.mark.parametrize("few", [1_024, 30])
def test_every_length_is_answered_among_its_own(spark, monkeypatch, few):
    monkeypatch.setattr(ann, "FEW_ROWS", few)
    r = np.random.default_rng(13)
    tables = {n: r.normal(size=(count, n)) for n, count in ((8, 300), (5, 60), (3, 25), (2, 1))}
    rows, own = [], {}
    for n, v in tables.items():
        own[n] = np.arange(len(v)) * 10 + n
        rows += [(int(i), [float(x) for x in x_]) for i, x_ in zip(own[n], v, strict=True)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    exact, near = {}, {}
    for n, v in tables.items():
        exact |= brute(np.floor(1024 * v), own[n], range(len(v)), 10)
        near |= brute(v, own[n], range(len(v)), 20)
    found = by_query(topk.top_k(table, F.lit(True)).collect())
    assert found == {q: [(i, int(s)) for i, s in best] for q, best in exact.items() if best}
    found = by_query(ann.nearest_neighbours(table, F.lit(True)).collect())
    assert found.keys() == {q for q, best in near.items() if best}
    for q, best in near.items():
        if best:
            same = len({i for i, _ in found[q]} & {i for i, _ in best})
            assert len(found[q]) == len(best) and same >= 0.7 * len(best)
    rare = {q for q in near if q % 10 == 3 or (q % 10 == 5 and few > 60)}
    assert all([i for i, _ in found[q]] == [i for i, _ in near[q]] for q in rare)


@pytest.mark.parametrize("points", [np.random.default_rng(2).normal(size=(3000, 5)), np.ones((500, 3))])
def test_nodes_cover_their_rows(points):
    def check(node):
        far = np.sqrt(((points[node.rows] - node.centre) ** 2).sum(axis=1))
        assert far.max() <= node.radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
            for c in node.children:
                check(c)

    check(topk.build(points))


def test_queries_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    matrix, ids = np.array([r["embedding"] for r in rows]), np.array([r["vec_id"] for r in rows])
    found = by_query(QUERIES["op5_ann"](spark, sf_dir).collect())
    expected = brute(matrix, ids, np.flatnonzero(ids % 20 == 0), 20)
    hits = sum(len({v for v, _ in found[q]} & {v for v, _ in best}) for q, best in expected.items())
    assert hits >= 0.9 * 20 * len(expected)
    found = by_query(QUERIES["op9_topk"](spark, sf_dir).collect())
    expected = brute(np.floor(1024 * matrix), ids, np.flatnonzero(ids % 100 == 0), 10)
    assert found == {q: [(v, int(s)) for v, s in best] for q, best in expected.items()}


def test_few_leaves_meet_where_bounds_prune_little(monkeypatch):
    r = np.random.default_rng(9)
    data = np.floor(1024 * r.normal(size=(6000, 64)) / 8)
    dual = topk.DualSearch(data[:500], np.arange(500), np.zeros(500, dtype=np.int64), 10)
    met = []
    leaves = dual._leaves
    monkeypatch.setattr(dual, "_leaves", lambda *given: met.append(1) or leaves(*given))
    for start in range(0, 6000, 3000):
        block = slice(start, start + 3000)
        dual.add(data[block], np.arange(6000)[block], np.zeros(3000, dtype=np.int64))
    assert len(met) < 300
    products = data[:500] @ data.T
    products[np.arange(500), np.arange(500)] = -np.inf
    for q in (0, 99, 499):
        best = np.lexsort((np.arange(6000), -products[q]))[:10]
        assert dual.found[q][:, 0].tolist() == best.tolist() and dual.scores[q].tolist() == products[q][best].tolist()
