import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesselar import schemas
from tesselar.plans import grams
from tesselar.plans.grams import GramIndex
from tesselar.plans.store import ChunkTable

TEXTS = [None, "", "a", "ab", "abc", "ABCabcAbc", "MAX_SIZE = 5\nMAX_SIZES = 6", "ünï İstanbul ſ ﬁ 日本語 日本", "aaaaaaaa", "x\0y\0\0", "tail ab", "def get_churn_limit(state):\n    return 1", "end", "\n", "ab" * 500]
NAMES = ["", "a", "ab", "abc", "MAX_size", "aaaa", "日", "日本", "本語", "İ", "ï", "\0", "y\0\0", "\0\0", "zz", "get_churn_limit", "end", "nd", "ab" * 100, "b\n", "%", "_", "A", "\n", "ﬁ", "tail ab\0"]


def records(spark, texts, first=0):
    made = [(f"c{first + i}", t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(made, "chunk_id string, content string").repartition(3)
    return frame.select(*[F.col(f.name) if f.name in ("chunk_id", "content") else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.RECORD.fields])


def scan(rows, names):
    """The same by reading every content."""
    asked = rows.sparkSession.createDataFrame([(n,) for n in names], "name string")
    return sorted((r[0], r[1]) for r in rows.crossJoin(F.broadcast(asked)).where(F.contains(F.lower("content"), F.lower("name"))).select("name", "chunk_id").collect())


@pytest.mark.parametrize("small", [False, True])
def test_find_equals_a_scan(spark, tmp_path, monkeypatch, small):
    if small:
        monkeypatch.setattr(grams, "SEGMENT", 40)
        monkeypatch.setattr(grams, "BLOCK", 9)
    table = ChunkTable(spark, str(tmp_path))
    table.replace(records(spark, TEXTS), 1)
    index = GramIndex(spark, table)
    assert index.refresh(1) == [1] and index.refresh(1) == []
    found = index.find(NAMES)
    assert sorted((r.name, r.chunk_id) for r in found.collect()) == scan(table.live(1), NAMES)
    places = {(r.name, r.chunk_id): r.places for r in found.collect()}
    assert places["abc", "c5"] == [0, 3, 6] and places["aaaa", "c8"] == [0, 1, 2, 3, 4] and places["MAX_size", "c6"] == [0, 13]
    assert {f.split("/specs/")[1].split("/commit=")[0] for f in index.find(["abc"]).inputFiles()} == {"grams/postings", "grams/places"}  # no content is read


def test_grams_follow_commits(spark, tmp_path):
    table = ChunkTable(spark, str(tmp_path))
    index = GramIndex(spark, table)
    table.replace(records(spark, ["alpha beta", "beta", "gamma"]), 1)
    index.refresh(1)
    table.delete(spark.createDataFrame([("c1",)], "chunk_id string"), 2)
    table.append(records(spark, ["more BETA", "delta"], 10), 2)
    assert index.refresh(2) == [2]
    assert sorted(r.chunk_id for r in index.rows("beta", 2).collect()) == ["c0", "c10"]
    assert sorted(r.chunk_id for r in index.rows("beta", 1).collect()) == ["c0", "c1"] and index.rows("none", 2).count() == 0
    assert [r.chunk_id for r in index.rows("beta", 2, F.col("chunk_id") == "c10").collect()] == ["c10"]
    table.compact(2, 3)
    assert index.refresh(3) == [3] and index.numbers("postings") == [3]
    assert sorted(r.chunk_id for r in index.rows("beta", 3).collect()) == ["c0", "c10"]


def test_many_hits_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(grams, "FETCHED", 5)
    table = ChunkTable(spark, str(tmp_path))
    table.replace(records(spark, [f"common {i}" for i in range(300)]), 1)
    index = GramIndex(spark, table)
    index.refresh(1)
    assert index.rows("common", 1).count() == 300 and index.rows("common 29", 1).count() == 11
    empty = ChunkTable(spark, f"{tmp_path}/e")
    assert GramIndex(spark, empty).find(["x"]).count() == 0 and GramIndex(spark, empty).find([]).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=60), st.binary(min_size=1, max_size=7), st.integers(0, 50))
def test_occurrences_of_bytes(data, name, at):
    import numpy as np

    data = data[:at] + name + data[at:]
    padded = data + b"\0\0"
    keys = np.sort(np.array([(int.from_bytes(padded[i : i + 3], "big") << grams.PLACE) | i for i in range(len(data))], np.int64))
    want = [i for i in range(len(data)) if padded[i : i + len(name)] == name and i + len(name) <= len(padded)]
    assert grams._occurrences(keys, grams._cover(name)).tolist() == want


def test_many_names_meet_a_segment_at_once(spark, tmp_path, monkeypatch):
    """A look-up's time may not be the number of names times that of segments: no name is intersected on its own."""
    monkeypatch.setattr(grams, "FETCHED", 20)
    monkeypatch.setattr(grams, "PLACES_AT_ONCE", 50)
    monkeypatch.setattr(grams, "WALKED", 7)
    monkeypatch.setattr(grams, "ROWS", 3)
    monkeypatch.setattr(grams, "_occurrences", lambda *a: 1 / 0)
    r = random.Random(3)
    texts = ["".join(r.choice("abcé ") for _ in range(r.randrange(200))) for _ in range(60)]
    names = sorted({t[i : i + n] for t in texts for i in range(0, len(t), 9) for n in (3, 4, 5, 6, 7, 9, 20)} | {"abcabcabcabcz", "CAB", "cab", "aBc "})
    names = [n for n in names if len(n.encode()) > 2]
    table = ChunkTable(spark, str(tmp_path))
    table.replace(records(spark, texts), 1)
    table.delete(spark.createDataFrame([("c3",), ("c0",), ("c59",)], "chunk_id string"), 2)
    index = GramIndex(spark, table)
    index.refresh(2)
    assert sorted((x.name, x.chunk_id) for x in index.find(names, 2).collect()) == scan(table.live(1), names)
    found = index.find(names, 2, live=True).collect()
    assert sorted((x.name, x.chunk_id) for x in found) == scan(table.live(2), names)
    for x in found:
        t, n = texts[int(x.chunk_id[1:])].encode(), x.name.lower().encode()
        assert x.places == [i for i in range(len(t)) if t.startswith(n, i)]


def shuffled(spark):
    """Bytes that all stages so far have written for other stages."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_postings_do_not_move_between_tasks(spark, tmp_path, monkeypatch):
    """Neither an index nor a look-up of many names shuffles postings, so that disk does not grow with blocks of names; 4 blocks here."""
    monkeypatch.setattr(grams, "SEGMENT", 200_000)
    r = random.Random(5)
    texts = ["".join(r.choice("abcdefgh ") for _ in range(20_000)) for _ in range(60)]
    names = sorted({t[i : i + 7] for t in texts for i in range(0, 20_000, 2_000)})
    monkeypatch.setattr(grams, "BLOCK", 8 * len(names) // 4)
    table = ChunkTable(spark, str(tmp_path))
    table.replace(records(spark, texts), 1)
    table.delete(spark.createDataFrame([("c3",)], "chunk_id string"), 2)
    index, before = GramIndex(spark, table), shuffled(spark)
    index.refresh(2)
    found = sorted((x.name, x.chunk_id) for x in index.find(names, 2, live=True).collect())
    assert shuffled(spark) - before < 100_000 < sum(map(len, texts)) and found == scan(table.live(2), names)


@pytest.mark.parametrize("sent", [0, 1 << 23])
def test_an_index_of_any_number_of_rows_is_looked_up(spark, tmp_path, monkeypatch, sent):
    """Rows that are too many to send to all tasks meet their postings in a shuffle, with the same result; a name reads its grams' columns."""
    monkeypatch.setattr(grams, "SENT", sent, raising=False)
    monkeypatch.setattr(grams, "SEGMENT", 30)
    table = ChunkTable(spark, str(tmp_path))
    table.replace(records(spark, TEXTS), 1)
    table.delete(spark.createDataFrame([("c8",), ("c5",)], "chunk_id string"), 2)
    index = GramIndex(spark, table)
    index.refresh(2)
    assert sorted((r.name, r.chunk_id) for r in index.find(NAMES, 2, live=True).collect()) == scan(table.live(2), NAMES)
    assert 1 <= len(set(re.findall(r"p\d\d:binary", index.find(["abcd"])._jdf.queryExecution().executedPlan().toString()))) <= 2
