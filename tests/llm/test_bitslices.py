import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesselar.llm import bitslices, terms
from tesselar.llm.common import Workspace

from . import helpers
from .test_terms import plain

ITEMS = "item_id bigint, text string, rank string, score string, number int"


def items():
    rows = [(i, helpers.prose(i + 1, 12), "r", "s", 1) for i in range(8)]
    return rows + [(20, None, "", "", 1), (21, "", "", "", 1), (22, "nowhere at-all", "", "", 1), (23, "same SAME same words", "", "", 1), (None, "word two", "", "", 1), (24, "word", "", "", 1), (24, "words", "", "", 1), (25, helpers.prose(2, 300), "", "", 1)]


def brute(docs, items, k=50):
    tokens = [(d[0], plain(d[1])) for d in docs]
    tokens = [(d, w) for d, w in tokens if w]
    n, total = len(tokens), sum(len(w) for _, w in tokens)
    df = Counter(t for _, w in tokens for t in set(w))
    asked = {}
    for i, t, *_ in items:
        asked.setdefault(i, set()).update(plain(t))
    out = []
    for item, need in asked.items():
        scored = []
        for doc, w in tokens:
            m, s = 50 + 50 * len(w) * n // total, 0
            for t, tf in Counter(w).items():
                if t in need:
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf // (1000 * tf + 20 * m))
            if s > 0:
                scored.append((-s, doc is None, doc or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def run(spark, docs, asked, k=50):
    ws = Workspace(spark, "t")
    n, total = bitslices.totals(docs)
    got = bitslices.search(bitslices.build(docs, ws, n, total), asked, ws, n, k)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_ranks_equal_brute_force(spark, monkeypatch, small):
    if small:  # several segments, blocks, steps of items and of terms; a long text in slices
        for module, name, value in ((terms, "SEGMENT", 3000), (terms, "BLOCK", 700), (terms, "SLICE", 900), (bitslices, "WORDS", 2), (bitslices, "TERMS", 3)):
            monkeypatch.setattr(module, name, value)
    got = run(spark, helpers.documents(spark), spark.createDataFrame(items(), ITEMS).repartition(2), 5 if small else 50)
    assert got == brute(helpers.rows(), items(), 5 if small else 50)


def test_ties_go_by_doc_id(spark):
    docs = [(i, "alpha beta gamma" if i % 3 else "alpha alpha delta", "en", "s", 1) for i in random.Random(1).sample(range(-500, 500), 700)]
    asked = [(1, "alpha"), (2, "gamma beta"), (3, "delta")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5)
    assert run(spark, frame, spark.createDataFrame(asked, "item_id bigint, text string")) == brute(docs, asked)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert run(spark, helpers.nothing(spark), none) == [] == run(spark, helpers.documents(spark), none) == run(spark, helpers.nothing(spark), spark.createDataFrame(items(), ITEMS))


def sliced(values, bits):
    flat = np.array([[[v >> b & 1 for v in row] for row in values] for b in range(bits)], np.uint8)
    return np.packbits(flat, axis=2, bitorder="little").view(np.uint64)


def numbers(slices):
    bits = np.unpackbits(slices.view(np.uint8), axis=2, bitorder="little").astype(object)
    return sum(bits[b] << b for b in range(len(bits))).tolist()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**20 - 1), min_size=64, max_size=64), min_size=1, max_size=4), st.data())
def test_arithmetic_and_top_k(values, data):
    weights = data.draw(st.lists(st.integers(0, 2**14 - 1), min_size=len(values), max_size=len(values)))
    made = bitslices.times(sliced(values, 20), np.array(weights))
    assert numbers(made) == [[v * w for v in row] for row, w in zip(values, weights, strict=True)]
    total = np.zeros((42, *made.shape[1:]), np.uint64)
    bitslices.add(total, made)
    bitslices.add(total, made[:, ::-1])
    sums = [[a * w + b * x for a, b in zip(r, q, strict=True)] for r, w, q, x in zip(values, weights, values[::-1], weights[::-1], strict=True)]
    assert numbers(total) == sums
    k = data.draw(st.integers(1, 70))
    top = np.unpackbits(bitslices.highest(total, k).view(np.uint8), axis=1, bitorder="little")
    for row, got in zip(sums, top, strict=True):
        assert np.flatnonzero(got).tolist() == sorted(sorted((i for i, v in enumerate(row) if v), key=lambda i: (-row[i], i))[:k])
