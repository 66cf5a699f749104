import hashlib
import random

import pytest

from tesselar.llm import phrases, terms
from tesselar.llm.common import Workspace

from . import helpers
from .test_terms import plain

ITEMS = "item_id bigint, text string, doc_id bigint, number string, spans int"


def items():
    r = random.Random(11)
    passage, out = plain(helpers.prose(99, 80)), []
    out += [(i, " ".join(passage[i : i + 10 + i % 7]), 1, "x", 2) for i in range(0, 60, 4)]
    out += [(100, None, 1, "", 1), (101, "", 1, "", 1), (102, "word", 1, "", 1), (103, "TWO-words!", 1, "", 1), (104, "same same same", 1, "", 1), (105, "same " * 12, 1, "", 1), (106, "никто 日本語", 1, "", 1)]
    out += [(107, helpers.prose(5, 120), 1, "", 1), (None, " ".join(passage[:20]), 1, "", 1), (0, " ".join(passage[:10]), 1, "", 1), (7, helpers.prose(r.random(), 30), 1, "", 1), (-3, "É x", 1, "", 1), (108, "日本語", 1, "", 1)]
    return out


def brute(docs, items, window=10):
    asked = [(i, plain(t)) for i, t, *_ in items if i is not None]
    asked = [(i, w[k : k + window]) for i, w in asked if w for k in range(max(1, len(w) - window + 1))]
    out = []
    for doc, text, *_ in docs:
        words, hit, found = plain(text), set(), set()
        for item, w in asked:
            for k in range(len(words) - len(w) + 1):
                if words[k : k + len(w)] == w:
                    hit |= set(range(k, k + len(w)))
                    found.add(item)
        out.append((doc, len(words), tuple(sorted(hit)), tuple(sorted(found))))
    return sorted(out, key=repr)


def read(frame):
    return sorted(((r.doc_id, r.n_words, tuple(k for s in r["spans"] for k in range(s.start, s.stop)), tuple(r["items"])) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_hits_equal_brute_force(spark, monkeypatch, small):
    if small:  # segments of a few rows, blocks of a few items, few starts at once
        for module, name, value in ((terms, "SEGMENT", 3000), (terms, "BLOCK", 600), (phrases, "STARTS", 50)):
            monkeypatch.setattr(module, name, value)
    docs, asked = helpers.rows(), items()
    got = phrases.contaminated(helpers.documents(spark), spark.createDataFrame(asked, ITEMS).repartition(2), Workspace(spark, "t"))
    assert got.columns == ["doc_id", "n_words", "spans", "items"]
    assert read(got) == brute(docs, asked)


def test_a_text_of_many_slices(spark, monkeypatch):
    monkeypatch.setattr(terms, "SLICE", 700)
    monkeypatch.setattr(terms, "SEGMENT", 20_000)
    docs, asked = helpers.rows(), items()
    from tesselar.llm import phrases as p

    ws = Workspace(spark, "t")
    rows = p.build(helpers.documents(spark).coalesce(1), ws)
    assert rows.where("term = 'same'").count() >= 1
    got = p.contaminated(helpers.documents(spark), spark.createDataFrame(asked, ITEMS), Workspace(spark, "t"))
    assert read(got) == brute(docs, asked)


def test_a_frequent_phrase_in_very_many_documents(spark):
    docs = [(i, "the same words " * 8 + f"end{i}", "en", "s", 1) for i in range(3000)] + [(9, "clean text", "en", "s", 1)]
    asked = [(1, "same words the same words the same words the same"), (2, "same words the same words the same words the same"), (3, "clean cloth")]
    got = read(phrases.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint"), spark.createDataFrame(asked, "item_id bigint, text string"), Workspace(spark, "t")))
    want = brute([docs[0], docs[-1]], asked)
    assert len(got) == 3001 and {(a[1:]) for a in got} == {w[1:] for w in want}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert phrases.contaminated(helpers.nothing(spark), none, Workspace(spark, "t")).count() == 0
    got = read(phrases.contaminated(helpers.documents(spark), none, Workspace(spark, "t")))
    assert got == brute(helpers.rows(), []) and phrases.contaminated(helpers.nothing(spark), spark.createDataFrame(items(), ITEMS), Workspace(spark, "t")).count() == 0


@pytest.mark.parametrize("within", [1, 4, 15])
def test_near_equals_brute_force(spark, within):
    asked = [(1, "same"), (2, "two words"), (3, " ".join(plain(helpers.prose(7, 9000, 3000))[40:43])), (4, "missing term"), (5, " ".join(plain(helpers.prose(2, 300))[i] for i in (3, 5, 6))), (None, "same"), (6, "")]
    ws = Workspace(spark, "t")
    index = phrases.build(helpers.documents(spark), ws)
    got = phrases.near(index, asked, within).join(phrases.documents_of(index), ["segment", "number"])
    want = []
    for doc, text, *_ in helpers.rows():
        words = plain(text)
        for item, t in asked:
            need = set(plain(t))
            if item is None or not need:
                continue
            spans = [(a, b) for a in range(len(words)) for b in range(a + len(need), min(a + within, len(words)) + 1) if need <= set(words[a:b])]
            want += [(doc, item, a, b) for a, b in spans if not any((c, d) != (a, b) and a <= c and d <= b for c, d in spans)]
    assert sorted(map(repr, ((r.doc_id, r.item_id, r.start, r.stop) for r in got.collect()))) == sorted(map(repr, want))


def test_query_columns(spark, tmp_path):
    helpers.documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items(), ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = phrases.op11_benchmark_decontamination(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("n_words", "bigint"), ("n_hit", "bigint"), ("n_items", "bigint"), ("items_sha256", "string"), ("contaminated", "boolean")]
    want = [(d, n, len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)) for d, n, hit, found in brute(helpers.rows(), items())]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
