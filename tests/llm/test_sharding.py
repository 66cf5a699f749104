import zlib
from collections import Counter, defaultdict

import numpy as np

from tesselar.llm import sharding

from .helpers import documents, nothing, rows


def test_fisher_yates_is_a_seeded_permutation():
    for n in (0, 1, 2, 1000):
        order = sharding.fisher_yates(n, (1, 2))
        assert sorted(order) == list(range(n)) and np.array_equal(order, sharding.fisher_yates(n, (1, 2)))
    first = Counter(int(sharding.fisher_yates(4, (s, 0))[0]) for s in range(4000))
    assert all(850 < first[i] < 1150 for i in range(4))


def test_shards(spark, tmp_path):
    runs = []
    for name in ("a", "b"):
        got = sharding.shuffle_shards(documents(spark), str(tmp_path / name), 5).collect()
        runs.append(Counter((r.doc_id, r.text, r.size, r.shard, r.slot) for r in got))
        assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in rows())
        slots = defaultdict(list)
        for r in got:
            assert r.size == len((r.text or "").encode()) + 8
            slots[r.shard].append(r.slot)
        sizes = [len(s) for s in slots.values()]
        assert len(slots) == 5 and max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert runs[0] == runs[1]


def test_more_shards_than_rows_and_no_rows(spark, tmp_path):
    got = sharding.shuffle_shards(documents(spark), str(tmp_path / "c"), 100).collect()
    assert len({r.shard for r in got}) == len(got) == len(rows()) and {r.slot for r in got} == {0}
    assert sharding.shuffle_shards(nothing(spark), str(tmp_path / "d")).collect() == []


def test_query_by_hand(spark, tmp_path):
    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = sharding.op6_shuffled_shards(spark, str(tmp_path))
    kinds = [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    assert [(f.name, f.dataType.simpleString()) for f in got.schema.fields] == kinds
    found = got.collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert {r.law for r in found} == {"rows"} and {r.grown_shard for r in found} == {None} and {r.shard for r in found} <= set(range(24))


def test_a_row_with_very_many_copies(spark, tmp_path):
    """Copies meet all buckets; nothing is lost, and a rerun over another layout gives the same."""
    from collections import Counter

    many = [(7, "a text of very many rows"), (None, None), (None, "no id, many rows")]
    data = [(i, f"text {i}") for i in range(500)] + [r for r in many for _ in range(9000)] + [(7, "another text of the id")]
    shown = lambda df: sorted(map(tuple, df.select("doc_id", "text", "shard", "slot").collect()), key=repr)
    frame = spark.createDataFrame(data, "doc_id bigint, text string")
    first = shown(sharding.shuffle_shards(frame.repartition(3), f"{tmp_path}/a"))
    assert Counter(r[:2] for r in first) == Counter(data) and first == shown(sharding.shuffle_shards(frame.repartition(7), f"{tmp_path}/b"))
    sizes = Counter(r[2] for r in first)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and all(sorted(x[3] for x in first if x[2] == s) == list(range(n)) for s, n in sizes.items())
    rows = frame.selectExpr("doc_id", "text", "crc32(cast(coalesce(text, '') as binary)) as crc", "cast(coalesce(octet_length(text), 0) + 8 as bigint) as size")
    got = sharding.numbered(rows, stretch=100)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(data)
    assert sorted(r.copy for r in got.where("doc_id = 7 and text like 'a text%'").collect()) == list(range(9000)) and got.where("doc_id < 500 and text like 'text%'").agg({"copy": "max"}).first()[0] == 0
    shares = Counter(r[2] for r in first if r[1] == many[0][1])
    assert len(shares) == 24 and max(shares.values()) < 3 * min(shares.values())
