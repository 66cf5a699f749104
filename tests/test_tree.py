import os

import pytest
from pyspark.sql import functions as F

from tesselar.plans import incremental
from tesselar.plans.incremental import Index
from tesselar.sources import files as S
from tesselar.sources import tree as T


@pytest.fixture
def folder(tmp_path):
    def put(path, text="x", time=None):
        file = tmp_path / "t" / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(text.encode() if isinstance(text, str) else text)
        if time:
            os.utime(file, ns=(time, time))
        return file

    for i in range(30):
        put(f"a{i % 3}/b{i % 5}/f{i}.md", f"# {i}\n", 1_000_000_000_000_000_001 + i)
    put("__init__.py", "A = 1\n")
    put(".hidden.md", "dot")
    put("ünï dir/ä %20 b.md", b"\xff\xfe bad")
    put("empty.md", "")
    os.symlink(tmp_path / "nowhere", tmp_path / "t" / "gone.md")
    os.symlink(tmp_path / "t" / "a0", tmp_path / "t" / "loop.md")
    return tmp_path / "t", put


def test_rows_are_files(spark, folder):
    root, _ = folder
    want = {str(p.relative_to(root)): (str(p), os.stat(p).st_mtime_ns, os.stat(p).st_size) for p in root.rglob("*") if p.is_file() and not p.is_symlink()}
    for folders in (1, 2, 7, 256):
        spark.dataSource.register(T.TreeSource)
        got = spark.read.format(T.FORMAT).option("folders", folders).load(str(root)).collect()
        assert {r.path: (r.abs_path, r.mtime_ns, r["size"]) for r in got} == want and len(got) == len(want)
    assert {r.path for r in T.tree(spark, f"file://{root}", names="*.md", recursive=False).collect()} == {".hidden.md", "empty.md"}
    with pytest.raises(FileNotFoundError):
        T.tree(spark, f"{root}/none")


def test_names_paths_and_times_are_tested_in_the_walk(spark, folder):
    root, _ = folder
    every, late = T.tree(spark, str(root)).collect(), 1_000_000_000_000_000_001 + 25
    tests = (({"after": late}, lambda r: r.mtime_ns > late), ({"before": late, "names": "f*.md"}, lambda r: r.mtime_ns < late and r.path.startswith("a")), ({"under": "a1/b"}, lambda r: r.path.startswith("a1/b")), ({"under": "a1/b2/f7.md"}, lambda r: r.path == "a1/b2/f7.md"), ({"under": "none"}, lambda r: False), ({"names": "*.py"}, lambda r: r.path.endswith(".py")), ({"under": "a2/", "after": late, "folders": 1}, lambda r: r.path.startswith("a2/") and r.mtime_ns > late))
    for options, keep in tests:
        rows = T.tree(spark, str(root), **options)
        assert sorted(r.path for r in rows.collect()) == sorted(r.path for r in every if keep(r))
        assert rows.where(F.col("size") > 10**9).count() == 0 and rows.count() == len([r for r in every if keep(r)])
    with pytest.raises(ValueError, match="path"):
        T.TreeReader({})


def test_contents_are_read_when_asked_for(spark, folder):
    root, _ = folder
    rows = S.notes_files(spark, str(root))
    assert "ArrowEvalPython" not in rows.select("path", "mtime_ns")._jdf.queryExecution().executedPlan().toString()
    found = {r.path: r.content for r in rows.collect()}
    assert found["ünï dir/ä %20 b.md"] == "�� bad" and found["empty.md"] == "" and found["a1/b1/f1.md"] == "# 1\n" and "gone.md" not in found


def test_an_update_without_changes_opens_no_file(spark, folder, tmp_path):
    root, put = folder
    index = Index(spark, f"{tmp_path}/index")
    index.index(S.notes_files(spark, str(root)))
    before = os.stat(root / "a0/b0/f0.md").st_mtime_ns
    put("a0/b0/f0.md", "# other bytes, same time\n", before)
    done = index.index(S.notes_files(spark, str(root)))
    assert done.summary() == incremental.NOTHING and done.same == 33
    put("a0/b0/f0.md", "# other bytes, other time\n", before + 1)
    assert index.index(S.notes_files(spark, str(root))).files == {"add": 0, "modify": 1, "delete": 0}
