import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselar.functions import vectors as VX
from tesselar.plans import quantised as Q
from tesselar.plans import search


def rows(spark, n=900, width=24):
    r = random.Random(5)
    clusters = [[r.gauss(0, 3) for _ in range(width)] for _ in range(12)]
    out = [(f"c{i:04d}", [c + r.gauss(0, 1) for c in clusters[i % 12]]) for i in range(n)]
    out += [(f"d{i}", [1.0] + [0.0] * (width - 1)) for i in range(40)]  # repeated vectors: ties go by key
    out += [("null", None), ("zero", [0.0] * width), ("nan", [float("nan")] * width), ("inf", [float("inf")] * width), ("short", [1.0]), ("empty", []), ("hole", [None] * width), ("huge", [1e160] * width), ("tiny", [1e-160] * width)]
    return spark.createDataFrame(out, "chunk_id string, vector array<double>").repartition(3), out


def plain(data, query, k):
    """The best k by cosine; zero vectors score 0, vectors that cannot be compared are not found."""
    q, scored = np.array(query, float), []
    for key, v in data:
        if v and len(v) == len(q) and all(x is not None and np.isfinite(x) for x in v):
            x = Q.units(np.array([v], float))[0]
            scored.append((-round(float(x @ Q.units(q[None])[0]), 9), key))
    return [key for _, key in sorted(scored)[:k]]


@pytest.mark.parametrize("parts", [1, 5, 24, 99])
def test_exact_search_equals_brute_force(spark, tmp_path, parts):
    frame, data = rows(spark)
    data = [x for x in data if x[0] not in ("huge", "tiny")]  # their squares leave a double's range in the score itself
    frame = frame.where("chunk_id not in ('huge', 'tiny')")
    books = Q.Books.load(Q.fit(frame, parts=parts).dump())
    Q.write(Q.encode(frame, books), f"{tmp_path}/codes")
    codes = spark.read.parquet(f"{tmp_path}/codes")
    assert codes.count() == 900 + 40 + 1 and codes.where("cell = -1").select("chunk_id").first()[0] == "zero"
    for query in (data[7][1], [1.0] + [0.0] * 23, [-x for x in data[3][1]]):
        for k in (1, 15, 60):
            assert [r.chunk_id for r in Q.search(codes, frame, books, query, k, exact=True).collect()] == plain(data, query, k)


def test_bounds_hold_and_recall(spark):
    frame, data = rows(spark)
    books = Q.fit(frame, parts=8)
    codes, query = Q.encode(frame, books), data[11][1]
    got = {r.chunk_id: r for r in Q.estimated(codes, books, query).collect()}
    q = Q.units(np.array([query]))[0]
    for key, v in data:
        if key in got:
            assert abs(float(Q.units(np.array([v], float))[0] @ q) - got[key].estimate) <= got[key].error + 1e-6
    assert {"huge", "tiny"} < set(got) and not {"null", "nan", "inf", "short", "empty", "hole"} & set(got)
    some = frame.where("chunk_id like 'c%'")
    assert Q.recall(codes, some, books, [v for k, v in data[:300:50]], 10) >= 0.9


def test_codes_are_small(spark, tmp_path):
    r = np.random.default_rng(1)
    x = r.normal(size=(4000, 384)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id bigint, vector array<float>").repartition(2)
    frame.write.parquet(f"{tmp_path}/rows")
    stored = spark.read.parquet(f"{tmp_path}/rows")
    Q.write(Q.encode(stored, Q.fit(stored)), f"{tmp_path}/codes")
    size = lambda p: sum(f.stat().st_size for f in (tmp_path / p).rglob("*.parquet"))
    assert size("codes") * 10 <= size("rows")


def test_no_vectors(spark):
    none = spark.createDataFrame([("a", None), ("b", [0.0, 0.0]), ("c", [])], "chunk_id string, vector array<double>")
    assert Q.fit(none) is None and Q.fit(none.limit(0)) is None


def test_batches_of_queries_in_blocks(spark):
    frame, data = rows(spark)
    data = [x for x in data if x[0] not in ("huge", "tiny")]
    frame = frame.where("chunk_id not in ('huge', 'tiny')")
    queries = spark.createDataFrame([("a", data[0][1]), ("b", [1.0] + [0.0] * 23), ("n", None), ("s", [2.0]), ("z", [0.0] * 24), (None, data[5][1])], "query_id string, query array<double>")
    for most in (1, 1 << 20):
        got = search.batch_search(frame, queries, 12, most=most).collect()
        by = {}
        for r in sorted(got, key=lambda r: r["rank"]):
            by.setdefault(r.query_id, []).append(r.chunk_id)
        assert by == {"a": plain(data, data[0][1], 12), "b": plain(data, [1.0] + [0.0] * 23, 12), "s": ["short"], "z": sorted(k for k, v in data if v and len(v) == 24 and None not in v and np.isfinite(v).all())[:12], None: plain(data, data[5][1], 12)}
    assert search.batch_search(frame, queries.limit(0), 3).count() == 0
    assert frame.select(VX.cosine(F.col("vector"), VX.literal([1.0] * 24)).alias("s")).where("s is not null").count() > 900


def test_many_queries_take_as_many_jobs_as_one(spark, monkeypatch):
    """Recall over many queries goes through the vectors once a block, and finds what single searches find."""
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 24))
    x[5] = x[4]
    x[9] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(300, None)], "vec_id bigint, v array<double>").repartition(3)
    books = Q.fit(rows, "v", "vec_id", parts=4)
    codes = Q.encode(rows, books, "v", "vec_id")
    queries = [v.tolist() for v in x[:40] if v.any()]
    many = Q.search_many(codes, rows, books, queries, 5, probes=6, depth=4, vector="v", key="vec_id").collect()
    for i in range(0, len(queries), 8):
        one = Q.search(codes, rows, books, queries[i], 5, probes=6, depth=4, vector="v", key="vec_id").collect()
        assert [(a.vec_id, a.score) for a in sorted((a for a in many if a.number == i), key=lambda a: (-a.score, a.vec_id))] == [(b.vec_id, b.score) for b in one]
    monkeypatch.setattr(Q, "search", lambda *a, **k: 1 / 0)
    assert 0 < Q.recall(codes, rows, books, queries, 5, "v", "vec_id", probes=6, depth=4) <= 1
