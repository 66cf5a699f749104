import pandas as pd
import pytest
from pyspark.sql import functions as F

from tesselar.plans import manifest as M
from tesselar.plans.incremental import Index
from tesselar.streaming import ingest

from .test_entries import notes, rebuilt, state


def event(path, text, time, gone=False, repo="pm"):
    return (path, "", "pm", repo, time, None if gone else f"# {path}\n\n{text}\n", gone)


RUNS = [
    [event(f"n{i}.md", f"text {i}", 10) for i in range(12)],
    [event("n1.md", "second", 20), event("n1.md", "third", 21), event("n2.md", "late", 5), event("n3.md", "text 3", 30), event("n4.md", "", 40, True), event("none.md", "", 40, True), event("n5.md", "", 41, True), event("n5.md", "back", 42)],
    [event("n1.md", "third", 21), event("n4.md", "again", 50), event("n6.md", "x", 60), event("n6.md", "", 60, True), event("n0.md", "text 0", 10), (None, "", "pm", "pm", 1, "lost", False), ("n7.md", "", "pm", "pm", None, "no time", False)],
]
AFTER = {"n0.md": ("text 0", 10), "n1.md": ("third", 21), "n2.md": ("text 2", 10), "n3.md": ("text 3", 30), "n4.md": ("again", 50), "n5.md": ("back", 42)} | {f"n{i}.md": (f"text {i}", 10) for i in range(7, 12)}


def write(spark, folder, runs):
    for i, rows in runs:
        spark.createDataFrame(rows, ingest.EVENT).repartition(3).write.parquet(f"{folder}/events/run={i}")


def stream(spark, folder):
    return spark.readStream.schema(ingest.EVENT).option("recursiveFileLookup", True).parquet(f"{folder}/events")


def test_runs_with_changes_equal_a_batch_update(spark, tmp_path):
    index = Index(spark, f"{tmp_path}/i")
    for i, rows in enumerate(RUNS):
        write(spark, tmp_path, [(i, rows)])
        ingest.upkeep(stream(spark, tmp_path), index, f"{tmp_path}/checkpoint").awaitTermination()
    want = rebuilt(spark, notes(spark, {k: v for k, (v, _) in AFTER.items()}, {k: t for k, (_, t) in AFTER.items()}), tmp_path)
    assert state(index) == want and index.manifest()[0].marks == {"upkeep": 2}
    number = index.manifest()[0].commit
    assert not index.index(notes(spark, {k: v for k, (v, _) in AFTER.items()}, {k: t for k, (_, t) in AFTER.items()})).files.get("modify") and index.manifest()[0].commit == number


def test_a_batch_is_committed_once(spark, tmp_path):
    index = Index(spark, f"{tmp_path}/i")
    rows = spark.createDataFrame([("pm", "a.md", "", "pm", 1, "# a\n\none\n", False, "a" * 64)], ingest.CHANGED)
    assert ingest.commit(index, rows, {"s": 0}) and not ingest.commit(index, rows.withColumn("content", F.lit("# a\n\ntwo\n")), {"s": 0})
    assert [r.content for r in index.live().collect()] == ["one"] and ingest.commit(index, rows.limit(0), {"s": 1})


def test_a_crash_before_the_header_is_made_good(spark, tmp_path, monkeypatch):
    index, plain = Index(spark, f"{tmp_path}/i"), M.save
    write(spark, tmp_path, [(0, RUNS[0])])
    ingest.upkeep(stream(spark, tmp_path), index, f"{tmp_path}/checkpoint").awaitTermination()
    before = state(index)
    write(spark, tmp_path, [(1, RUNS[1])])

    def fail(*_):
        raise OSError("no header")

    monkeypatch.setattr(M, "save", fail)
    with pytest.raises(Exception, match="no header"):
        ingest.upkeep(stream(spark, tmp_path), index, f"{tmp_path}/checkpoint").awaitTermination()
    assert state(index) == before
    monkeypatch.setattr(M, "save", plain)
    write(spark, tmp_path, [(2, RUNS[2])])
    ingest.upkeep(stream(spark, tmp_path), index, f"{tmp_path}/checkpoint").awaitTermination()
    assert state(index) == rebuilt(spark, notes(spark, {k: v for k, (v, _) in AFTER.items()}, {k: t for k, (_, t) in AFTER.items()}), tmp_path)


class Kept:
    """The state of one file."""

    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def test_rows_that_the_state_hands_on_bound_its_batches_in_bytes():
    """Spark ends a batch by its rows: a long content counts as many, and a file without a change as one, as its state is kept till then."""
    state, events = Kept(), lambda *rows: iter([pd.DataFrame(list(rows), columns=ingest.EVENT.fieldNames())])
    content = "\u00e9x" * 700_000
    first = list(ingest._newest(("pm", "a"), events(("a", "", "pm", "pm", 10, content, False)), state))
    quiet = list(ingest._newest(("pm", "a"), events(("a", "", "pm", "pm", 9, "late", False), ("a", "", "pm", "pm", 10, content, False)), state))
    assert [r.content for x in first for r in x.itertuples() if r.path] == [content] and state.get[0] == 10
    assert 3 * 700_000 <= ingest.ROW_BYTES * sum(map(len, first)) and [list(x.path) for x in quiet] == [[None]]


def test_a_stream_gives_changes_alone_whole_and_with_their_own_times(spark, tmp_path):
    time, texts = 1_700_000_000_123_456_789, {f"n{i}.md": "z" * (i * 40_000) for i in range(40)}
    write(spark, tmp_path, [(0, [("x", "", "pm", "pm", None, "no time", False), *[(k, "", "pm", "pm", time + i, v, False) for i, (k, v) in enumerate(texts.items())]])])
    found = ingest.newest(stream(spark, tmp_path)).writeStream.format("memory").queryName("whole").outputMode("append").trigger(availableNow=True)
    found.option("checkpointLocation", f"{tmp_path}/checkpoint").start().awaitTermination()
    assert {(r.path, r.content, r.mtime_ns) for r in spark.table("whole").collect()} == {(k, v, time + i) for i, (k, v) in enumerate(texts.items())} and spark.table("whole").count() == 40


def test_files_of_a_bucket_share_a_call_and_each_keeps_its_own_time():
    """A call of Python takes a bucket, not a file; what is late, repeated or gone again ends in it, and other files go on."""
    state, names = Kept(), ingest.EVENT.fieldNames()
    row = lambda path, time, text, gone=False, repo="r": (path, "", "pm", repo, time, text, gone)
    run = lambda *batches: [(r.repo, r.path, r.mtime_ns, r.content, r.gone) for x in ingest._newest((0,), iter([pd.DataFrame(list(b), columns=names) for b in batches]), state) for r in x.itertuples() if r.path]
    time = 1_700_000_000_123_456_789
    assert run([row("a", time, "one"), row("b", 5, ""), row("a", 3, "x", repo="s")], [row("a", time + 1, "two"), row("c", 5, None, True), row("a", 3, None, True, "s")]) == [("r", "a", time + 1, "two", False), ("r", "b", 5, "", False), ("s", "a", 3, None, True), ("r", "c", 5, None, True)]
    assert run([row("a", time, "late"), row("b", 5, ""), row("a", 4, "back", repo="s"), row("c", 6, None, True)], [row("d", 1, "d")]) == [("s", "a", 4, "back", False), ("r", "d", 1, "d", False)]
    assert run([row("c", 5, "late"), row("b", 5, "other"), row("a", time + 1, "two")]) == [("r", "b", 5, "other", False)] and not run([row("d", None, "no time")])


def test_the_number_of_states_does_not_grow_with_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "BUCKETS", 3, raising=False)
    files = [event(f"n{i}.md", f"text {i}", 10) for i in range(700)]
    runs = [files, [event("n3.md", "late", 9), event("n4.md", "new", 11), *files[:50]], [event("n5.md", "", 12, True), *files[50:]]]
    for i, rows in enumerate(runs):
        write(spark, tmp_path, [(i, rows)])
        found = ingest.newest(stream(spark, tmp_path)).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True)
        found.start(f"{tmp_path}/found").awaitTermination()
    got = {(r.path, r.mtime_ns, r.gone) for r in spark.read.parquet(f"{tmp_path}/found").collect()}
    assert got == {(x[0], 10, False) for x in files} | {("n4.md", 11, False), ("n5.md", 12, True)} and spark.read.parquet(f"{tmp_path}/found").count() == 702
    states = spark.read.format("statestore").load(f"{tmp_path}/checkpoint")
    assert states.count() == 3 and states.select(F.sum(F.size("value.groupState.paths"))).first()[0] == 700
