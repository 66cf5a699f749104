from collections import Counter, defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from tesselar.llm import mixing

from .helpers import documents, nothing, rows, words


def levels(sizes):
    """Targets by pouring the excess back until none is above, exactly."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction(i % 3 + 1) for i, s in enumerate(names)}
    target, left, open_ = {}, Fraction(sum(sizes.values())), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = Fraction(3 * sizes[s])
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_targets_and_takes(spark):
    sizes = defaultdict(int)
    for r in rows():
        sizes[r[3]] += len(words(r[1]))
    got = mixing.mix_counts(documents(spark)).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(words(r[1]))) for r in rows())
    taken, target = defaultdict(int), levels(sizes)
    source = {r[0]: r[3] for r in rows()}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - float(target[s])) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 2 * mixing.BLOCK for s in sizes)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix_counts(documents(spark).repartition(7)).collect()))


def test_small_sources_are_held_at_three_passes(spark):
    table = spark.createDataFrame([(i, " ".join(["w"] * n), s) for i, (n, s) in enumerate([(5000, "a"), (40, "b"), (10, "c"), (0, "d"), (3000, None)])], "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in mixing.mix_counts(table).collect()}
    want = levels({"a": 5000, "b": 40, "c": 10, "d": 0, None: 3000})
    assert all(abs(got[i].target - float(want[s])) < 1e-6 for i, s in enumerate(["a", "b", "c", "d", None]))
    assert got[1].taken <= 120 and abs(got[1].taken - 120) <= 16 and abs(got[2].taken - 30) <= 16


def test_quotas_are_sainte_lague(spark):
    targets = [("a", 5300.0), ("b", 2400.0), ("c", 2300.0), ("d", 7.0), ("e", 0.0)]
    frame = spark.createDataFrame(targets, "key string, target double")
    got = {r.key: r.quotas for r in mixing.quotas(frame, 100, 3).collect()}
    seats = sorted(((-t / (2 * j + 1), k) for k, t in targets if t for j in range(200)))
    total = round(sum(t for _, t in targets) / 100)
    ends = [total * s // 3 for s in range(4)]
    for k, _ in targets:
        assert got[k] == [sum(x == k for _, x in seats[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def test_seeded_order_is_a_bijection_of_any_size(spark):
    for n in (1, 2, 97, 1000, mixing.STRIDES[0]):
        some = min(n, 1000)
        got = spark.range(some).select(mixing.pick(F.col("id"), F.lit(n).cast("bigint"), mixing.stride(F.lit("a"), F.lit(n).cast("bigint")), F.lit(n // 3).cast("bigint")).alias("p")).collect()
        assert len({r.p for r in got}) == some and all(0 <= r.p < n for r in got)
    for n in (mixing.NARROW - 1, mixing.NARROW, 10**13 + 7, 2**62, mixing.STRIDES[3] * mixing.STRIDES[4]):
        blocks = [0, 1, n // 2, n - 1]
        frame = spark.createDataFrame([(b,) for b in blocks], "b bigint")
        size = F.lit(n).cast("bigint")
        got = [tuple(r) for r in frame.select("b", mixing.stride(F.lit("s"), size).alias("s"), mixing.pick(F.col("b"), size, mixing.stride(F.lit("s"), size), F.lit(n - 1).cast("bigint")).alias("p")).collect()]
        assert all(n % s and p == (b * s + n - 1) % n for b, s, p in got) and len({p for _, _, p in got}) == 4


def test_strides_are_seeded_primes(spark):
    assert all(p % d for p in mixing.STRIDES for d in range(2, int(p**0.5) + 1))
    got = spark.createDataFrame([(f"s{i}",) for i in range(50)], "name string").select(mixing.stride(F.col("name"), F.lit(1000)).alias("s")).collect()
    assert len({r.s for r in got}) > 4


def test_shards_take_their_quotas(spark):
    size, target, counts, source = defaultdict(int), {}, Counter(), {r[0]: r[3] for r in rows()}
    for r in mixing.mix_counts(documents(spark), 16, 4).collect():
        counts[r.doc_id] += r.taken
        size[source[r.doc_id]], target[source[r.doc_id]] = r.source_size, r.target
    got = mixing.mix_blocks(documents(spark), 16, 4).collect()
    found, taken = Counter(), defaultdict(set)
    for r in got:
        found[r.doc_id] += r.hi - r.lo
        taken[r.source, r.shard].add((r.block, r["pass"]))
    assert +found == +counts and {r.shard for r in got} == {0, 1, 2, 3}
    frame = spark.createDataFrame([(str(s), t) for s, t in target.items()], "key string, target double")
    quota = {r.key: r.quotas for r in mixing.quotas(frame, 16, 4).collect()}
    for s, own in quota.items():
        if sum(own) * 16 <= 2.9 * size[s if s != "None" else None]:  # others are cut by the limit of three passes
            assert all(abs(len(taken[s if s != "None" else None, i]) - q) <= 1 for i, q in enumerate(own)), (s, own)


def test_documents_follow_counts(spark):
    counts = Counter()
    for r in mixing.mix_counts(documents(spark)).collect():
        counts[r.doc_id] += r.taken
    got = mixing.mix_documents(documents(spark))
    assert got.columns == documents(spark).columns
    found = Counter()
    for r in got.collect():
        found[r.doc_id] += len(words(r.text))
        assert r.n_chars == (None if r.text is None else len(r.text))
    assert {k: v for k, v in found.items() if v} == {k: v for k, v in counts.items() if v}
    assert {r.doc_id for r in got.where(F.col("text").isNull()).collect()} == {1}


def test_nothing(spark):
    assert mixing.mix_counts(nothing(spark)).collect() == []
    assert mixing.mix_documents(nothing(spark)).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id bigint, text string, source string")
    assert {(r.size, r.target, r.taken) for r in mixing.mix_counts(blank).collect()} == {(0, 0.0, 0)}
