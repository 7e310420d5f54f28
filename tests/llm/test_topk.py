import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import topk


def brute(rows, ids, q, own, k):
    scores = [(-int(np.dot(r, q)), int(i)) for r, i in zip(rows, ids) if i != own]
    return [(i, -s) for s, i in sorted(scores)[:k]]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 200), st.integers(1, 9), st.integers(1, 25))
def test_threshold_walk_matches_brute_force(seed, n, dims, k):
    rng = np.random.default_rng(seed)
    rows, ids = rng.integers(-3, 4, (n, dims)), rng.permutation(3 * n)[:n]
    queries = np.vstack([rows[:3], np.zeros((1, dims), dtype=int)])
    own = np.append(ids[:3], -1)[-len(queries) :]
    for (q, got, scores), row, me in zip(topk.threshold_topk(rows, ids, queries, own, k), queries, own):
        assert q == me
        assert list(zip(got.tolist(), map(int, scores))) == brute(rows, ids, row, me, k)


def test_odd_vectors_and_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 40)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(1)
    base = [(i, rng.normal(size=4).round(1).tolist()) for i in range(200)]
    odd = [(200, None), (220, [1.0, None, 0.0, 0.0]), (240, [float("nan")] * 4), (260, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (280, [1.0, 2.0]), (281, [2.0, 2.0]), (300, [])]
    frame = spark.createDataFrame(base + odd + [base[7]], "vec_id long, embedding array<float>")
    frame = frame.selectExpr("*", "1 AS v", "2 AS score", "3 AS d")
    got = {}
    for r in topk.top_k(frame).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = [(i, np.floor(np.array(v, dtype=np.float32).astype(float) * 64)) for i, v in [*base, base[7]]]
    for q in range(0, 200, 20):
        want = brute([v for _, v in whole], [i for i, _ in whole], dict(whole)[q], q, 20)
        assert [(i, s) for _, i, s in sorted(got[q])] == want
    assert [(i, s) for _, i, s in got[280]] == [(281, 64 * 128 + 128 * 128)]
    assert 200 not in got and 220 not in got and 260 not in got
    assert topk.top_k(frame.limit(0)).count() == 0


def test_rows_of_a_repeated_id_are_dealt_to_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 40)
    frame = spark.createDataFrame([(7 if i % 3 else i, [float(i % 5), 1.0]) for i in range(400)] + [(20, [1.0, 0.0])], "vec_id long, embedding array<float>")
    sizes = [r["count"] for r in topk._rows(frame).groupBy(topk._dealt("salt", 10)).count().collect()]
    assert len(sizes) == 10 and max(sizes) <= 80
    best = sorted((r.rank, r.vec_id, r.score) for r in topk.top_k(frame).where("query_id = 20").collect())
    scores = sorted(((-64 * 64 * (i % 5), 7 if i % 3 else i) for i in range(400)))[:20]
    assert [(i, s) for _, i, s in best] == [(i, -s) for s, i in scores]


def test_scores_known_from_elsewhere_leave_out_only_lower_rows():
    rng = np.random.default_rng(4)
    rows, ids = np.floor(rng.normal(size=(900, 12)) / np.arange(1, 13) * 64).astype(np.int64), np.arange(900)
    queries, k = rows[:30], 10
    for raised in (0, 300, 10**6):
        floors = np.array([float(brute(rows, ids, q, -1, k)[-1][1] + raised) for q in queries])
        scored = []
        for (_, got, scores), q, floor in zip(topk.threshold_topk(rows, ids, queries, np.full(30, -1), k, floors, scored), queries, floors):
            want = [x for x in brute(rows, ids, q, -1, k) if x[1] >= floor]
            assert [(i, int(s)) for i, s in zip(got, scores) if s >= floor] == want
        assert len(scored) == 30 and (raised < 10**6 or sum(scored) < 30 * 200)


def test_the_walk_stops_early_where_few_dimensions_decide():
    rng = np.random.default_rng(5)
    rows = np.floor(rng.normal(size=(4000, 16)) * 0.2 ** np.arange(16) * 640).astype(np.int64)
    scored = []
    for (_, got, scores), q in zip(topk.threshold_topk(rows, np.arange(4000), rows[:40], np.arange(40), 20, scored=scored), rows):
        own = int(np.flatnonzero((rows[:40] == q).all(axis=1))[0])
        assert list(zip(got.tolist(), map(int, scores))) == brute(rows, np.arange(4000), q, own, 20)
    assert np.mean(scored) < 0.5 * 4000


def test_more_than_the_usual_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 50)
    frame = spark.createDataFrame([(i, [float(i % 7), float(i % 3)]) for i in range(120)], "vec_id long, embedding array<float>")
    got = topk.top_k(frame, k=40).where("query_id = 20").collect()
    rows = np.array([[64 * (i % 7), 64 * (i % 3)] for i in range(120)])
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == brute(rows, np.arange(120), rows[20], 20, 40)
