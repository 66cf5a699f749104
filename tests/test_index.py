import json
import os

import pytest

from tesselar import catalog, cli
from tesselar.operators import clients as C
from tesselar.operators import specs as SP
from tesselar.plans import api, incremental, search, validation
from tesselar.plans import manifest as M
from tesselar.plans.incremental import Index, Plan, Result
from tesselar.sources import config as G
from tesselar.sources import files as S
from tesselar.streaming import ingest
from tesselar.functions import vectors as VX

from .test_chunking import RUST, SPEC


@pytest.fixture
def checkout(tmp_path):
    def put(path, text):
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text, encoding="utf-8")
        return file

    put("consensus-specs/specs/electra/beacon-chain.md", SPEC)
    put("consensus-specs/specs/deneb/ünï.md", "# Deneb\n\nBlobs are here.\n")
    put("EIPs/EIPS/eip-4844.md", "---\neip: 4844\ntitle: Blobs\n---\n# Abstract\n\nBlob transactions.\n")
    put("EIPs/EIPS/deep/eip-1.md", "# no\n")
    put("builder-specs/specs/api.md", "# API\n\nPOST `/eth/v1/builder`\n")
    put("leanSpec/src/lean_spec/types.py", "MAX_SIZE: int = 5\n\n\ndef encode(x: int) -> bytes:\n    return b''\n")
    put("leanSpec/src/lean_spec/test_types.py", "A = 1\n")
    put("leanSpec/src/lean_spec/__pycache__/c.py", "A = 1\n")
    put("leanSig/src/lib.rs", RUST)
    put("leanSig/target/gen.rs", RUST)
    put("leanSig/src/my_test.rs", "pub fn t() {}\n")
    put("pm/notes.md", "# Call\n\nAgenda of the call.\n")
    put("clients/reth/a.rs", RUST)
    return tmp_path, put


def test_sources(spark, checkout):
    root, _ = checkout
    names = lambda df: sorted(r.path for r in df.collect())
    assert names(S.spec_files(spark, f"{root}/consensus-specs")) == ["specs/deneb/ünï.md", "specs/electra/beacon-chain.md"]
    assert names(S.eip_files(spark, f"{root}/EIPs")) == ["EIPS/eip-4844.md"]
    assert names(S.python_spec_files(spark, f"{root}/leanSpec")) == ["src/lean_spec/types.py"]
    assert names(S.rust_files(spark, f"{root}/leanSig", "leanSig")) == ["src/lib.rs", "src/my_test.rs"]
    assert names(S.rust_source_files(spark, f"{root}/leanSig", "leanSig")) == ["src/lib.rs"]
    with pytest.raises(FileNotFoundError):
        S.spec_files(spark, f"{root}/none")
    with pytest.raises(LookupError, match="csharp"):
        S.client_files(spark, f"{root}/clients/reth", "nethermind", "csharp")
    listed = S.listing(spark, S.eip_files(spark, f"{root}/EIPs")).first()
    assert listed.mtime_ns == os.stat(f"{root}/EIPs/EIPS/eip-4844.md").st_mtime_ns
    assert S.binary_hashes(spark, f"{root}/EIPs").count() == 2
    assert {r.repo: r.present for r in S.on_disk(spark, catalog.client_repos(spark).select("repo"), f"{root}/clients").collect()}["reth"]
    assert S.load_client_items(spark, f"{root}/none").count() == 0


def test_index_lifecycle(spark, checkout):
    root, put = checkout
    index = Index(spark, f"{root}/index")
    gather = lambda: cli.gather(spark, str(root))
    assert index.dry_run(gather()).reason
    first = index.index(gather())
    assert first.reason == "No manifest exists" and first.chunks_in == index.live().count() > 10
    again = index.index(gather())
    assert again.reason is None and again.summary() == "No changes detected" and again.same == first.files["add"]
    before = {r.chunk_id for r in index.live().collect()}
    put("consensus-specs/specs/deneb/ünï.md", "# Deneb\n\nBlobs have moved.\n")
    put("pm/new.md", "# New\n\nA new page.\n")
    os.utime(put("builder-specs/specs/api.md", "# API\n\nPOST `/eth/v1/builder`\n"), ns=(1, 1))
    os.remove(f"{root}/EIPs/EIPS/eip-4844.md")
    plan = index.dry_run(gather())
    assert {k: plan.first(k) for k in plan.files} == {"add": ["pm/new.md"], "modify": ["consensus-specs/specs/deneb/ünï.md"], "delete": ["EIPs/EIPS/eip-4844.md"]}
    assert plan.summary().startswith("Would perform incremental update:\n  Add 1 files\n  Modify 1 files\n  Delete 1 files\n  ~20 chunks to add")
    stats = index.index(gather())
    assert stats.files == {"add": 1, "modify": 1, "delete": 1} and (stats.chunks_in, stats.chunks_out) == (2, 3)
    after = {r.chunk_id for r in index.live().collect()}
    assert len(before - after) == 3 and len(after - before) == 2
    found, reason = index.manifest()
    assert reason is None and found.files["builder-specs/specs/api.md"].mtime_ns == 1 and sum(len(f.chunk_ids) for f in found.files.values()) == len(after)
    assert Index(spark, f"{root}/index", size=500).manifest()[1].startswith("Chunk config changed")
    index.table.append(index.live().drop("commit").limit(1), found.commit + 7)  # a crash before the commit
    assert {r.chunk_id for r in index.live().collect()} == after
    with open(index.manifest_path, "w") as f:
        f.write("{")
    rebuilt = index.index(gather())
    assert rebuilt.reason.startswith("Manifest unusable") and os.path.exists(index.manifest_path + ".corrupted")
    assert {r.chunk_id for r in index.live().collect()} == after
    index.table.compact(1 << 20, 1 << 20)
    assert index.table.live().count() == len(after)


def test_service(spark, checkout):
    root, _ = checkout
    index = Index(spark, f"{root}/index")
    service = api.Service(spark, index)
    assert service.health()["healthy"] is False
    index.index(cli.gather(spark, str(root)))
    from pyspark.sql import functions as F

    from tesselar.functions.text import fork_of_path

    specs = S.spec_files(spark, f"{root}/consensus-specs").withColumn("fork", fork_of_path(F.col("path")))
    service = api.Service(spark, index, SP.compile_specs(specs), specs)
    assert service.health()["healthy"]
    hits = service.search("blob transactions", limit=5)
    assert hits[0]["eip"] == "4844" and hits[0]["github_url"] == "https://github.com/ethereum/EIPs/blob/master/EIPS/eip-4844.md" and [h["score"] for h in hits] == sorted((h["score"] for h in hits), reverse=True)
    assert service.grep_constant("MAX_A")[0]["value"] == "Gwei(2**5)" and service.grep_constant("MISSING_X") == []
    assert "return a" in service.analyze_function("first")[0]["content"]  # not the first thing in its block, so it is searched for
    assert service.analyze_function("second")[0]["source"].startswith("def second")
    assert service.search_eip("blobs", "4844")[0]["eip"] == "4844" and service.search_eip("blobs", "1") == []
    assert service.search_lean_spec("encode")[0]["chunk_type"].startswith("lean_") and service.search_lean_pq("sign", repo="leanSig")[0]["repo"] == "leanSig"
    assert all(h["chunk_type"] != "eip" for h in service.search_specs("blobs"))
    for bad in (service.search(""), service.search("x", "gloas"), service.search("x", limit=0), service.search("x", limit=51), service.search("x" * 1001), service.grep_constant("lower"), service.analyze_function("Upper"), service.search_eip("x", "4a"), service.search_lean_pq("x", repo="none"), service.list_clients("middle"), service.get_client("zzz"), service.expert_guidance("zzz")):
        assert list(bad[0])[0] == "error"
    assert service.get_client("  GETH ")[0]["percentage"] == 55.0 and len(service.list_clients()) == 10 and service.get_current_fork()[0]["name"] == "electra"
    assert service.expert_guidance("slashing")[0]["key"] == "slashing" and len(service.get_client_diversity()) == 10 and len(service.get_recommended_client_pairs()) == 6
    service.add_guidance(catalog.guidance(spark).limit(1).withColumn("topic", F.lit("Fresh")))
    assert service.expert_guidance("fresh")[0]["topic"] == "Fresh" and service.get_spec_version()["index_exists"]


def test_search_modes(spark):
    rows = spark.createDataFrame([(f"c{i}", "a" if i % 2 else "b", [float(i), 1.0]) for i in range(10)], "chunk_id string, chunk_type string, vector array<float>")
    from pyspark.sql import functions as F

    want = F.col("chunk_type") == "b"
    assert search.search(rows, [1.0, 0.0], 4, want).count() == 4 and search.search(rows, [1.0, 0.0], 4, want, 1, False).count() == 2
    assert [r.chunk_id for r in search.search(rows, [1.0, 0.0], 2).collect()] == ["c9", "c8"]
    assert rows.select(VX.cosine(F.col("vector"), VX.literal([0.0, 0.0])).alias("s")).distinct().collect()[0].s == 0.0
    plan = rows.where(want)._jdf.queryExecution().toString()
    assert "chunk_type" in plan


def test_manifest_files(tmp_path):
    path = str(tmp_path / "m.json")
    assert M.load(path) is None
    entry = M.FileEntry("a" * 64, 1234567890123456789, ["c1"])
    M.save(M.Manifest(embedding_model="m", files={"ünï/a.md": entry}), path)
    assert M.load(path).files == {"ünï/a.md": entry} and os.listdir(tmp_path) == ["m.json"]
    for bad in ({"version": "1"}, {"files": []}, {"files": {"../x": {"sha256": "a" * 64, "mtime_ns": 1}}}, {"files": {"x": {"sha256": "zz", "mtime_ns": 1}}}, {"files": {"x": {"sha256": "a" * 64, "mtime_ns": 1, "chunk_ids": ["c"] * 10_001}}}, {"files": {"x": {"size": 1}}}):
        with open(path, "w") as f:
            json.dump(bad, f)
        with pytest.raises(M.ManifestInvalid):
            M.load(path)
    with open(path, "w") as f:
        f.write(" " * (10 * 1024 * 1024 + 1))
    with pytest.raises(M.ManifestInvalid, match="larger"):
        M.load(path)
    assert M.needs_rebuild(None, "m", {}) and M.needs_rebuild(M.Manifest(embedding_model="a"), "b", {}) and M.needs_rebuild(M.Manifest(chunk_config={"a": 1}), "b", {"a": 2}) and not M.needs_rebuild(M.Manifest(), "b", {"a": 2})


@pytest.mark.parametrize(("hashes", "want"), [(True, {"new": "add", "both": "modify", "gone": "delete"}), (False, {"new": "add", "both": "modify", "gone": "delete", "touched": "modify"})])
def test_changes(spark, hashes, want):
    now = spark.createDataFrame([("new", 1, "x"), ("both", 2, "y"), ("same", 3, "z"), ("touched", 9, "t")], "path string, mtime_ns bigint, sha256 string")
    old = spark.createDataFrame([("both", "o", 1, ["a", "b"]), ("same", "other", 3, []), ("touched", "t", 1, []), ("gone", "g", 1, ["c"])], "path string, sha256 string, mtime_ns bigint, chunk_ids array<string>")
    changes = incremental.compute_changes(now, old, hashes)
    assert {r.path: r.change_type for r in changes.collect()} == want
    counts = incremental.change_counts(changes).first()
    assert counts.files_added == 1 and counts.chunks_deleted == 3
    assert {r.path for r in incremental.suspects(now, old).collect()} == {"new", "both", "touched"}


def test_summaries():
    assert Result(chunks_in=5, reason="r").summary() == "Full rebuild: 5 chunks indexed (r)" and Result(same=4).summary() == "No changes detected"
    assert Result({"add": 1, "modify": 2, "delete": 3}, 4, 5).summary() == "Incremental update: 1 added, 2 modified, 3 deleted (4 chunks added, 5 deleted)"
    assert Plan("r").summary() == "Would perform full rebuild: r" and Plan().summary() == "No changes detected" and Plan().first("add") == []
    assert Plan(None, {"modify": 2}, (20, 7)).summary() == "Would perform incremental update:\n  Modify 2 files\n  ~20 chunks to add\n  ~7 chunks to delete"


def test_config(tmp_path):
    path = str(tmp_path / "c.yaml")
    assert G.load_config(path, {}).chunking.chunk_size == 1000
    G.save_config(G.Config(chunking=G.Chunking(500, 50)), path)
    assert G.load_config(path, {}).chunk_config == {"chunk_size": 500, "chunk_overlap": 50}
    env = {G.MODEL_VARIABLE: "all-mpnet-base-v2", G.BATCH_VARIABLE: "64"}
    assert G.load_config(path, env).embedding == G.Embedding("all-mpnet-base-v2", 64) and G.load_config(path, {G.BATCH_VARIABLE: "x"}).embedding.batch_size == 32
    for bad in ("chunking: {chunk_size: 50}", "chunking: {chunk_overlap: 1000}", "embedding: {batch_size: 0}", "embedding: {model: 'voyage:voyage-code-3'}", "chunking: {chunk_size: big}"):
        (tmp_path / "b.yaml").write_text(bad)
        with pytest.raises(G.ConfigError):
            G.load_config(str(tmp_path / "b.yaml"), {})
    (tmp_path / "b.yaml").write_text("{: [")
    with pytest.warns(UserWarning):
        assert G.load_config(str(tmp_path / "b.yaml"), {}).chunking.chunk_size == 1000
    (tmp_path / "b.yaml").write_text("#" * (1 << 21))
    with pytest.raises(G.ConfigError, match="larger"):
        G.load_config(str(tmp_path / "b.yaml"), {})
    assert G.model_info("hashing").startswith("hashing:") and len(G.model_info().splitlines()) == 5


def test_clients(spark, checkout):
    root, _ = checkout
    found = C.compile_clients(S.client_files(spark, f"{root}/clients/reth", "reth", "rust"))
    assert {(r.category, r.name) for r in C.name_index(found).collect()} == {("functions", "sign"), ("functions", "later"), ("functions", "new"), ("structs", "Key"), ("structs", "Unit"), ("constants", "SIZE"), ("constants", "LOW")}
    assert C.lookup(found, "sign").first().signature.startswith("fn sign") and C.lookup(found, "SIZE", "constant").first().value == "32"
    assert {r.client for r in C.unsupported(catalog.client_repos(spark)).collect()} == {"nethermind", "nimbus-eth2", "builder-specs"}
    total = {r.client: r for r in C.statistics(found).collect()}
    assert total[None].functions == total["reth"].functions == 3


def test_stream_of_a_drop_folder(spark, checkout, tmp_path):
    root, put = checkout
    index = Index(spark, str(tmp_path / "stream"))
    for i in range(2):
        put(f"drop/n{i}.md", f"# N{i}\n\nnote {i}\n")
        ingest.upkeep(ingest.drop_folder(spark, f"{root}/drop", "pm", "pm", "*.md"), index, str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(r.content for r in index.live().collect()) == ["note 0", "note 1"] and index.manifest()[0].marks == {"upkeep": 1}


def test_cli(spark, checkout, capsys):
    root, _ = checkout
    for argv in (["index"], ["update"], ["dry-run"], ["search", "blob transactions", "--limit", "2"], ["compile"], ["compile-clients"], ["status"], ["models"]):
        assert cli.main(["--data", str(root), *argv], spark) == 0
    out = capsys.readouterr().out
    assert "Full rebuild" in out and "No changes detected" in out and "Blob transactions" in out
    compiled = S.read_compiled(spark, f"{root}/compiled/*.json")
    assert "MAX_A" in compiled.where("fork = 'electra'").first().constants


def test_paths_and_rules(tmp_path):
    assert api.safe_path(str(tmp_path), "a", "b").endswith("/a/b")
    for bad in ("../x", "/etc/passwd", "a/../../x"):
        with pytest.raises(ValueError, match="leaves"):
            api.safe_path(str(tmp_path), bad)
    assert validation.fork("ELECTRA") == "electra" and validation.client(" GeTh ") == "geth"


def test_embedder():
    a = VX.hash_embed(["Blob blob data", "", None, "x" * 10])
    assert a.shape == (4, 384) and abs((a[0] ** 2).sum() - 1) < 1e-6 and not a[1].any() and not a[2].any()
    with pytest.raises(LookupError):
        VX.embedder("none")
    VX.register("ones", lambda t: VX.np.ones((len(t), 3)))
    assert VX.encode_query("x", "ones") == [1.0, 1.0, 1.0]


def test_cells(spark, tmp_path):
    import random

    from tesselar.plans import cells

    r = random.Random(1)
    rows = spark.createDataFrame([(f"c{i}", [r.gauss(3 * (i % 4 == j), 1) for j in range(4)]) for i in range(400)] + [("n", None), ("z", [0.0] * 4)], "chunk_id string, vector array<float>")
    centres = cells.fit(rows, cells=4)
    cells.write(cells.assign(rows, centres), str(tmp_path / "cells"))
    stored = spark.read.parquet(str(tmp_path / "cells"))
    exact = [x.chunk_id for x in search.search(rows.where("vector is not null"), [1.0, 0, 0, 0], 10).collect()]
    assert [x.chunk_id for x in cells.search(stored, centres, [1.0, 0, 0, 0], 10, 4).collect()] == exact
    near = [x.chunk_id for x in cells.search(stored, centres, [1.0, 0, 0, 0], 10, 1).collect()]
    assert len(set(near) & set(exact)) >= 8 and stored.where("cell = -1").count() == 1
    assert cells.fit(rows.limit(0)) == []
