import hashlib
from collections import Counter

import pytest

from tesselar.llm import substring
from tesselar.llm.common import Workspace

from .helpers import documents, nothing, prose, rows, thue_morse, words


def brute(table, window=50):
    first = {}
    for doc_id, text in table:
        w = words(text)
        for i in range(len(w) - window + 1):
            if doc_id is not None:
                k = tuple(w[i : i + window])
                first[k] = min(doc_id, first.get(k, doc_id))
    out = []
    for doc_id, text in table:
        w, gone = words(text), set()
        for i in range(len(w) - window + 1):
            if doc_id is not None and first[tuple(w[i : i + window])] < doc_id:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("batches", [1, 2, 7])
def test_against_brute_force(spark, batches):
    got = substring.substring_report(documents(spark), batches)
    assert Counter(map(tuple, got.collect())) == Counter(brute([(r[0], r[1]) for r in rows()]))


def test_small_windows_and_compaction(spark):
    table = [(i, prose(i, 40, 6)) for i in range(30)]
    index = substring.FingerprintIndex(Workspace(spark, "lsm"), 2)
    for lo in range(0, 30, 5):
        rows_ = [(a, i) for i in range(lo, lo + 5) for a in {hash((i + j) % 40) for j in range(8)}]
        index.add(spark.createDataFrame(rows_, "anchor bigint, doc_id bigint")).collect()
    assert len(index.runs) <= 2 and index.made > 6
    got = substring.substring_report(spark.createDataFrame(table, "doc_id bigint, text string"), 5, 4, 2)
    assert Counter(map(tuple, got.collect())) == Counter(brute(table, 4))


def test_later_batches_against_a_kept_index(spark, tmp_path):
    table, seen, got = [(i, prose(i % 7, 60, 5)) for i in range(40)], [], []
    for lo in range(0, 40, 8):
        batch = table[lo : lo + 8]
        index = substring.FingerprintIndex.open(spark, str(tmp_path / "index"))
        frame = lambda x: spark.createDataFrame(x, "doc_id bigint, text string")
        got += substring.substring_report(frame(batch), 1, 6, 3, index, frame(seen)).collect()
        seen += batch
    assert Counter(map(tuple, got)) == Counter(brute(table, 6))
    last = substring.FingerprintIndex.open(spark, str(tmp_path / "index"))
    assert last.version == 5 and len(last.runs) <= substring.RUNS


def test_words_are_compared_not_their_hashes(spark):
    a, b = thue_morse(), thue_morse("ba")
    table = [(1, f"{prose(1, 30)} {a} {prose(2, 30)}"), (2, f"{prose(1, 30)} {b} {prose(2, 30)}"), (3, f"{prose(1, 30)} {a} {prose(2, 30)}")]
    got = substring.substring_report(spark.createDataFrame(table, "doc_id bigint, text string"))
    assert Counter(map(tuple, got.collect())) == Counter(brute(table))


def test_pipeline_stage(spark):
    want = {r[0]: r for r in brute([(r[0], r[1]) for r in rows()])}
    got = substring.drop_repeats(documents(spark))
    assert got.columns == documents(spark).columns
    texts = {r[0]: r[1] for r in rows()}
    seen = Counter()
    for r in got.collect():
        n = want[r.doc_id][2]
        if n:
            assert hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id][3] and r.n_chars == len(r.text)
        else:
            assert r.text == texts[r.doc_id]
        seen[r.doc_id] += 1
    assert set(seen) == {d for d, n, g, _ in want.values() if g < n or n == 0} and seen[None] == 1


def test_nothing(spark):
    assert substring.substring_report(nothing(spark)).collect() == []
    assert substring.drop_repeats(nothing(spark)).collect() == []
