import hashlib
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as pipeline
from tesselar.llm import mixing, tokens

from .helpers import documents, rows, words
from .test_simhash import expected
from .test_substring import brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    documents(spark).write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, stages = docs.columns, dict(pipeline.STAGES)
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "mix_sources", "pack_sequences"]
    one = stages["language_id"](spark, docs, folder)
    assert Counter(r.doc_id for r in one.collect()) == Counter(r[0] for r in rows() if any(c.isalpha() for c in r[1] or ""))
    two = stages["near_dedup"](spark, one, folder)
    least = {d for d, _, c in expected() if d is None or d == c}
    assert {r.doc_id for r in two.collect()} == {d for d in least if d in {r.doc_id for r in one.collect()}}
    three = stages["substring_dedup"](spark, two, folder)
    want = {(d, h) for d, n, g, h in brute([(r.doc_id, r.text) for r in two.collect()]) if g < n}
    assert {(r.doc_id, hashlib.sha256(b" ".join(words(r.text))).hexdigest()) for r in three.collect()} == want
    four = stages["mix_sources"](spark, three, folder)
    taken, found = Counter(), Counter()
    for r in mixing.mix_counts(three).collect():
        taken[r.doc_id] += r.taken
    for r in four.collect():
        found[r.doc_id] += len(words(r.text))
    assert found == +taken
    assert one.columns == two.columns == three.columns == four.columns == columns


def test_run_packs_the_mix(spark, folder):
    got = pipeline.run(spark, folder).collect()
    used = Counter()
    for r in got:
        used[r.sequence_id] += r.length
    assert got and max(used.values()) <= 4096
    assert all(len(r.ids) == 4 * r.length for r in got)
    assert sum(np.frombuffer(r.ids, np.uint32)[-1] == 1 for r in got) >= len({r.doc_id for r in got})
    assert tokens.END == b"\x01\0\0\0"


def test_run_packs_the_words_of_the_mix(spark, folder):
    """The packed ids of each document are those of the rows that the stages before it made."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    mixed = docs.collect()
    coder = tokens.WordIds(tokens.vocabulary())
    want = Counter()
    for r in mixed:
        data = (r.text or "").encode()
        want[r.doc_id, coder.pack(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]] += 1
    pieces = {}
    for r in pipeline.run(spark, folder).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    assert set(pieces) == {d for d, _ in want}
    for doc_id, found in pieces.items():
        assert Counter(b for _, ids in found for b in [ids]) == Counter(x[i : i + 4 * 4096] for (d, x), n in want.items() if d == doc_id for _ in range(n) for i in range(0, len(x), 4 * 4096))


def test_run_on_an_empty_table(spark, tmp_path):
    documents(spark).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).collect() == []
