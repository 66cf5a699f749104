"""The index as a log of commits: sizes of updates, crashes between writes, checkpoints, vacuum, cached vectors."""

import json

import pytest

from tesselar.functions import vectors as VX
from tesselar.plans import incremental
from tesselar.plans import manifest as M
from tesselar.plans.embeddings import EmbeddingCache
from tesselar.plans.entries import EntryLog
from tesselar.plans.incremental import Index
from tesselar.schemas import FILE, FILE_ENTRY


def notes(spark, texts, times=None):
    """Rows of ``schemas.FILE``: notes of one chunk by path."""
    rows = [(path, "", "pm", "pm", (times or {}).get(path, 1), f"# {path}\n\n{text}\n") for path, text in texts.items()]
    return spark.createDataFrame(rows, FILE).repartition(3)


def state(index):
    found, reason = index.manifest()
    entries = {r.path: (r.sha256, r.mtime_ns, tuple(r.chunk_ids)) for r in found.frame(index.spark).collect()}
    return reason, entries, sorted((r.source, r.content, r.chunk_id) for r in index.live().collect())


def rebuilt(spark, files, tmp_path):
    """What an index of the same files, built at once, holds."""
    index = Index(spark, f"{tmp_path}/fresh")
    index.index(files, force=True)
    return state(index)


BEFORE = {f"n{i}.md": f"text {i}" for i in range(40)}
AFTER = {k: v for k, v in BEFORE.items() if k != "n1.md"} | {"n2.md": "changed", "new.md": "fresh"}
TIMES = {"n2.md": 2, "new.md": 3, "n3.md": 9}


def test_an_update_writes_what_changed(spark, tmp_path):
    index = Index(spark, f"{tmp_path}/i")
    index.index(notes(spark, BEFORE))
    done = index.index(notes(spark, AFTER, TIMES))
    assert done.files == {"add": 1, "modify": 1, "delete": 1} and done.same == 38
    assert incremental.written(index) == {"segments": 2, "tombstones": 2, "delta": 4, "checkpoint": 0}  # three changes and a touched file
    assert state(index) == rebuilt(spark, notes(spark, AFTER, TIMES), tmp_path)
    again = index.index(notes(spark, AFTER, TIMES))
    assert again.summary() == "No changes detected" and again.same == 40 and index.table.last() == 2 == index.log.last()
    touched = index.index(notes(spark, AFTER, TIMES | {"n5.md": 77}))
    assert not any(touched.files.values()) and incremental.written(index)["delta"] == 1 and index.manifest()[0].files["pm/n5.md"].mtime_ns == 77


class Crash(Exception):
    pass


@pytest.mark.parametrize("step", ["tombstones", "segments", "delta", "header", "checkpoint"])
def test_a_crash_between_writes_changes_nothing(spark, tmp_path, monkeypatch, step):
    index = Index(spark, f"{tmp_path}/i")
    index.log.every = 1
    index.index(notes(spark, BEFORE))
    before = state(index)
    plain_write, plain_save = type(index.table).write, M.save

    def write(self, rows, kind, commit):
        plain_write(self, rows, kind, commit)
        if kind == step:
            raise Crash

    def save(manifest, path):
        if step == "header":
            raise Crash
        plain_save(manifest, path)

    with monkeypatch.context() as m:
        m.setattr("tesselar.plans.store.Commits.write", write)
        m.setattr(M, "save", save)
        with pytest.raises(Crash):
            index.index(notes(spark, AFTER, TIMES))
    after = rebuilt(spark, notes(spark, AFTER, TIMES), tmp_path)
    assert state(index) == (after if step == "checkpoint" else before)  # a checkpoint comes after the commit
    # the next update, of other files, takes nothing of what was left
    only = {"n7.md": "seven", **{k: v for k, v in BEFORE.items() if k != "n7.md"}}
    index.index(notes(spark, only, {"n7.md": 5}))
    assert state(index) == rebuilt(spark, notes(spark, only, {"n7.md": 5}), tmp_path)


def test_checkpoints_compaction_and_vacuum(spark, tmp_path):
    index, texts, times = Index(spark, f"{tmp_path}/i"), dict(BEFORE), {}
    index.log.every = 3
    index.index(notes(spark, texts))
    for i in range(5):
        texts[f"n{i}.md"], times[f"n{i}.md"] = f"again {i}", 10 + i
        index.index(notes(spark, texts, times))
    assert index.log.numbers("checkpoint") == [1, 4] and index.log.numbers("delta") == [2, 3, 4, 5, 6]
    want, older = rebuilt(spark, notes(spark, texts, times), tmp_path), sorted(r.content for r in index.table.live(5).collect())
    assert state(index) == want and index.vacuum(2) == ["entries/checkpoint/commit=1", "entries/delta/commit=2", "entries/delta/commit=3", "entries/delta/commit=4"]
    assert state(index) == want and sorted(r.content for r in index.table.live(5).collect()) == older
    index.compact()
    assert state(index) == want and index.table.numbers("segments") == [1, 2, 3, 4, 5, 6, 7]
    index.vacuum()
    assert state(index) == want and index.table.numbers("segments") == [7] and index.table.numbers("tombstones") == [] and index.log.numbers("delta") == []
    with pytest.raises(M.ManifestError):
        index.vacuum(0)
    assert not any(index.index(notes(spark, texts, times)).files.values())


def test_stored_entries_are_checked(spark, tmp_path):
    index = Index(spark, f"{tmp_path}/i")
    index.index(notes(spark, BEFORE))
    bad = spark.createDataFrame([("pm/n0.md", "no hash", 1, ["c"], False), ("../x", "a" * 64, 1, [], False)], "path string, sha256 string, mtime_ns bigint, chunk_ids array<string>, gone boolean")
    index.log.append(bad, 2)
    found, _ = index.manifest()
    found.commit = 2
    M.save(found, index.manifest_path)
    done = index.index(notes(spark, BEFORE))
    assert done.reason == "Manifest unusable: 2 entries break a rule" and state(index) == rebuilt(spark, notes(spark, BEFORE), tmp_path)


def test_empty_and_odd_tables(spark, tmp_path):
    index = Index(spark, f"{tmp_path}/i")
    none = spark.createDataFrame([], FILE)
    assert index.index(none).chunks_in == 0 and index.index(none).summary() == "No changes detected"
    assert index.index(notes(spark, BEFORE)).files["add"] == 40 and index.index(none).files == {"add": 0, "modify": 0, "delete": 40}
    assert index.live().count() == 0 and index.manifest()[0].files.totals() == (0, 0)
    log = EntryLog(spark, f"{tmp_path}/log")
    assert log.state(5).count() == 0 and log.state(5).schema.fieldNames() == FILE_ENTRY.fieldNames() and not log.checkpoint(0)


def test_only_new_contents_are_encoded(spark, tmp_path):
    asked = f"{tmp_path}/asked"

    def make():
        def run(texts):
            with open(asked, "a", encoding="utf-8") as f:
                f.write("".join(json.dumps(t) + "\n" for t in texts))
            return VX.hash_embed(texts, 8)

        return run

    def encoded():
        try:
            with open(asked, encoding="utf-8") as f:
                return [json.loads(line) for line in f]
        except FileNotFoundError:
            return []

    VX.register_maker("counted", make)
    texts = BEFORE | {"copy.md": "text 1", "twin.md": "text 1"}
    index = Index(spark, f"{tmp_path}/i", "counted")
    assert index.index(notes(spark, texts)).chunks_in == 42
    first = encoded()
    assert sorted(first) == sorted({r.content for r in index.live().collect()}) and index.encoded == len(first) == 40
    other = Index(spark, f"{tmp_path}/i", "counted", size=900)  # other chunk settings: a rebuild with the same contents
    assert other.index(notes(spark, texts)).reason.startswith("Chunk config changed") and encoded() == first and other.encoded == 0
    index = Index(spark, f"{tmp_path}/i", "counted", size=900)
    index.index(notes(spark, texts | {"n1.md": "unseen", "n2.md": "text 3"}, {"n1.md": 2, "n2.md": 2}))
    assert encoded()[40:] == ["unseen"]
    vectors = {r.content: r.vector for r in index.live().collect()}
    assert all(v == VX.hash_embed([c], 8)[0].tolist() for c, v in vectors.items())
    cache = EmbeddingCache(spark, f"{tmp_path}/i/vectors", "counted")
    assert len(cache.numbers("vectors")) == 2
    cache.compact()
    assert len(cache.numbers("vectors")) == 1 and cache.known().count() == 41
    assert EmbeddingCache(spark, f"{tmp_path}/i/vectors", "other").known().count() == 0
