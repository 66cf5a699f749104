import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tesselar.llm import simhash
from tesselar.llm.common import Workspace, components

from .helpers import documents, nothing, rows, words


def plain(text):
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in words(text)]
    grams = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(values, errors=4):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= errors:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def expected():
    table = [(r[0], plain(r[1])) for r in rows()]
    found = roots([f for _, f in table])
    least = {}
    for (doc_id, _), root in zip(table, found, strict=True):
        if doc_id is not None:
            least[root] = min(doc_id, least.get(root, doc_id))
    return sorted(((d, f"{f:016x}", least.get(r)) for (d, f), r in zip(table, found, strict=True)), key=str)


def test_against_brute_force(spark):
    got = simhash.near_duplicates(documents(spark))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected()


def test_trie_join_finds_every_pair():
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(300)]
    values = set(base)
    for v in base[:100]:
        for _ in range(5):
            x = v
            for b in r.sample(range(64), r.randrange(7)):
                x ^= 1 << b
            values.add(x)
    values = np.array(sorted(values), np.uint64)
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (int(values[i]) ^ int(values[j])).bit_count() <= 4}
    assert {(int(a), int(b)) for i, j in simhash.close_pairs(values, None) for a, b in zip(i, j, strict=True)} == want
    a, b = values[::2], values[1::2]
    cross = {(i // 2, j // 2) for i, j in want if i % 2 == 0 and j % 2} | {(j // 2, i // 2) for i, j in want if i % 2 and j % 2 == 0}
    assert {(int(x), int(y)) for i, j in simhash.close_pairs(a, b) for x, y in zip(i, j, strict=True)} == cross
    lo, hi = simhash.forest(values, None)
    assert len(lo) < len(values)


def near_values(seed, n):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(n)] + [r.getrandbits(20) for _ in range(n)]  # half of them share 44 bits
    for v in base[: 2 * n]:
        x = v
        for b in r.sample(range(64), r.randrange(1, 7)):
            x ^= 1 << b
        base.append(x)
    return sorted(set(base))


@pytest.mark.parametrize(("rows_", "n"), [(1 << 20, 200), (40, 200), (2, 60)])
def test_links_of_dealt_subtrees(spark, rows_, n):
    values = near_values(7, n)
    frame = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp bigint")
    got = {r.fp: r.root for r in simhash.link(Workspace(spark, "t"), frame, rows=rows_).collect()}
    groups = {}
    for v, root in zip(values, roots(values), strict=True):
        groups.setdefault(root, set()).add(got[int(np.uint64(v).astype(np.int64))])
    assert len(got) == len(values) and all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_layouts_keep_close_pairs_together(spark):
    assert len(simhash.layouts(10**6)) == 5 and len(simhash.layouts(5 * 10**10)) == 15
    r, chosen = random.Random(1), simhash.layouts(10**12)
    for _ in range(200):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), 4):
            b ^= 1 << bit
        pair = np.array([a, b], np.uint64)
        shared = 0
        for order, width in chosen:
            x = simhash.reorder(pair, order)
            assert np.array_equal(simhash.restore(x, order), pair)
            shared += int(x[0]) >> (64 - width) == int(x[1]) >> (64 - width)
        assert shared >= 1
    order, width = chosen[3]
    value = r.getrandbits(64)
    signed = int(np.uint64(value).astype(np.int64))
    got = spark.createDataFrame([(signed,)], "fp bigint").select(simhash.front_bits(F.col("fp"), order, width).alias("x")).first().x
    assert got == int(simhash.reorder(np.array([value], np.uint64), order)[0]) >> (64 - width)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 101), (200, 150), (150, 180), (1, 0)]
    got = {r.node: r.root for r in components(Workspace(spark, "t"), spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 150: 150, 180: 150, 200: 150}


def test_keep_one(spark):
    want = {d for d, _, c in expected() if d is not None and d == c}
    got = simhash.keep_one(documents(spark))
    assert got.columns == documents(spark).columns
    kept = [r.doc_id for r in got.collect()]
    assert sorted(x for x in kept if x is not None) == sorted(want) and kept.count(None) == 1


def test_nothing(spark):
    assert simhash.near_duplicates(nothing(spark)).collect() == []
    assert simhash.keep_one(nothing(spark)).collect() == []
