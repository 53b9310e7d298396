"""Search over several regions, blocks and parts, of several lengths, against all distances."""

import numpy as np
import pytest

from tallyhouse.llm import nearest


def all_distances(rows, is_query, k):
    """By query its k nearest of the same length, by distance and then id."""
    best = {}
    for i, v in rows:
        if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            best.setdefault(i, v)
    out = {}
    for q, v in best.items():
        if is_query(q):
            near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), i) for i, w in best.items() if i != q and len(w) == len(v))
            out[q] = near[:k]
    return out


@pytest.mark.parametrize("region,block,queries", [(128, 64, 8), (100_000, 50, 1000), (200, 100_000, 5)])
def test_regions_blocks_and_parts(spark, monkeypatch, region, block, queries):
    monkeypatch.setattr(nearest, "REGION", region)
    monkeypatch.setattr(nearest, "BLOCK", block)
    monkeypatch.setattr(nearest, "QUERIES", queries)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 24)) * 4
    rows = [(i, (centres[i % 20] + rng.normal(size=24)).tolist()) for i in range(900)]
    rows += [(2000 + i, rows[i][1]) for i in range(30)] + [(3000 + i, [0.0] * 24) for i in range(3)]
    df = spark.createDataFrame([(i, v, i, 0.5) for i, v in rows], "vec_id long, embedding array<double>, rank long, score double").repartition(5)
    got = {}
    for r in sorted(nearest.search(df, "vec_id % 10 = 0", k=10).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    want = all_distances(rows, lambda i: i % 10 == 0, 10)
    assert got.keys() == want.keys() and all(len(got[q]) == 10 for q in got)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    exact = {(q, i): s for q in want for s, i in all_distances(rows, lambda i, q=q: i == q, 2000)[q]}
    assert all(s == pytest.approx(exact[q, i], rel=1e-12) for q in got for s, i in got[q]) and all(got[q] == sorted(got[q]) for q in got)


def test_lengths_and_shared_ids(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(40)] + [(100 + i, rng.normal(size=3).tolist()) for i in range(8)] + [(200, [1.0])]
    rows += [(0, rows[0][1])] * 3 + [(None, rows[1][1]), (300, None), (301, []), (302, [float("nan")] * 6), (303, [None] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(nearest.search(df, "vec_id % 10 = 0", k=5).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((pytest.approx(r["score"]), r["vec_id"]))
    want = {q: near for q, near in all_distances(rows, lambda i: i % 10 == 0, 5).items() if near}
    assert got == want and 100 in got and 200 not in got
    # One id with two vectors: one of them stands for it, the same however rows are dealt.
    twice = df.unionByName(spark.createDataFrame([(1, rng.normal(size=6).tolist()), (1, rng.normal(size=6).tolist())], "vec_id long, embedding array<double>"))
    once = [sorted(map(tuple, nearest.search(twice.repartition(n), "vec_id % 10 = 0", k=5).collect())) for n in (1, 7)]
    assert once[0] == once[1] and max(sum(1 for x in once[0] if x[0] == 10 and x[2] == 1), 0) <= 1
