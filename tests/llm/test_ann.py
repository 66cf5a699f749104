import math
import random

import numpy as np
import pytest

from tesselar.llm import ann

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, rank string"


def table(spark):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)], 1, "x", "y") for i in range(900)]
    rows += [(1000 + i, [0.5] * 8, None, None, None) for i in range(300)]
    rows += [(2000, None, 1, "", ""), (2100, [], 1, "", ""), (2200, [0.0] * 8, 1, "", ""), (2300, [1.0, None] + [1.0] * 6, 1, "", ""), (2400, [float("nan")] * 8, 1, "", ""), (2500, [float("inf")] * 8, 1, "", ""), (None, [1.0] * 8, 1, "", ""), (2600, [1.0, 2.0], 1, "", ""), (2601, [1.0, 2.5], 1, "", ""), (100, rows[100][1], 1, "", "")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), rows


def plain(rows, k=10, every=100):
    """Rows (vec_id, vector): the smallest vector of a query's id asks, candidates count once with their nearest vector."""
    good = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault(i, set()).add(tuple(np.array(v, np.float32).astype(float).tolist()))
    want = set()
    for q, vectors in good.items():
        if q % every == 0:
            a, scored = min(vectors), []
            for i, others in good.items():
                found = []
                for b in others:
                    total = 0.0
                    for x, y in zip(a, b, strict=len(a) == len(b)):
                        total += (x - y) * (x - y)
                    if len(a) == len(b):
                        found.append(math.sqrt(total))
                if i != q and found:
                    scored.append((min(found), i))
            want |= {(q, n + 1, i, s) for n, (s, i) in enumerate(sorted(scored)[:k])}
    return want


def same(got, want):
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize(("query_rows", "candidate_rows"), [(4096, 65536), (3, 100)])
def test_against_brute_force(spark, query_rows, candidate_rows):
    df, rows = table(spark)
    got = ann.nearest(df, query_rows=query_rows, candidate_rows=candidate_rows)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema.fields] == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    same(got.collect(), plain(rows))


@pytest.mark.parametrize("candidate_rows", [65536, 7])
def test_repeated_ids(spark, candidate_rows):
    r = random.Random(9)
    one = [r.gauss(0, 1) for _ in range(8)]
    rows = [(0, [x + 0.1 for x in one])] + [(1, one)] * 25 + [(i, one) for i in range(2, 26)]  # equal vectors
    rows += [(50, [x + r.gauss(0, 0.01) for x in one]) for _ in range(30)]  # one id, many vectors, all near
    rows += [(100, [r.gauss(0, 1) for _ in range(8)]) for _ in range(5)] + [(60 + i, [x + r.gauss(0, 0.3) for x in one]) for i in range(20)]
    same(ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3), candidate_rows=candidate_rows).collect(), plain(rows))


def test_fewer_candidates_than_k(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0, 1.0])]
    same(ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect(), plain(rows))


def test_bounds_hold():
    x = np.random.default_rng(1).normal(size=(50, 16))
    code, scale, norm, loss = ann.quantise(x)
    near = code * scale[:, None]
    assert np.abs(code).max() <= 127 and np.allclose(np.linalg.norm(near, axis=1), norm) and np.allclose(np.linalg.norm(x - near, axis=1), loss)


def test_nothing(spark):
    assert ann.nearest(spark.createDataFrame([], SCHEMA)).collect() == []
