"""Command line: index, update, dry-run, search, compile, status, models, clients."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog
from .functions.text import fork_of_path, preview, shown_score
from .operators import clients as C
from .operators.specs import compile_specs
from .plans.incremental import Index
from .plans.manifest import StoredFiles
from .plans.search import Searcher
from .sources import files as S
from .sources.config import load_config, model_info

_READERS = {"spec": S.spec_files, "eip": S.eip_files, "builder": S.builder_files, "lean": S.python_spec_files}


def gather(spark: SparkSession, root: str) -> DataFrame:
    """All known checkouts below a folder, tagged by type."""
    found = [read(spark, f"{root}/{repo}") for repo, read in (("consensus-specs", S.spec_files), ("EIPs", S.eip_files), ("builder-specs", S.builder_files), ("leanSpec", S.python_spec_files)) if os.path.isdir(f"{root}/{repo}")]
    for name, _, _, language, _ in [(p[0], p[1], p[2], p[3], p[4]) for p in catalog.PQ_REPOS]:
        if os.path.isdir(f"{root}/{name}"):
            found.append({"rust": lambda d, n=name: S.rust_files(spark, d, n), "markdown": lambda d, n=name: S.notes_files(spark, d, n), "python": lambda d, n=name: S.python_files(spark, d, n)}[language](f"{root}/{name}"))
    if not found:
        raise SystemExit(f"no known checkout below {root}")
    return S.union_sources(*found)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser("tesselar", description=__doc__)
    p.add_argument("--data", default=".")
    p.add_argument("--config")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "update"):
        sub.add_parser(name).add_argument("--force", action="store_true")
    sub.add_parser("dry-run")
    q = sub.add_parser("search")
    q.add_argument("query")
    q.add_argument("--fork")
    q.add_argument("--limit", type=int, default=5)
    sub.add_parser("compile")
    sub.add_parser("compile-clients")
    sub.add_parser("status")
    sub.add_parser("models").add_argument("name", nargs="?")
    a = p.parse_args(argv)
    if a.command == "models":
        print(model_info(a.name))
        return 0
    spark = spark or SparkSession.builder.appName("tesselar").getOrCreate()
    config = load_config(a.config or f"{a.data}/config.yaml")
    index = Index(spark, f"{a.data}/index", config.embedding.model, config.chunking.chunk_size, config.chunking.chunk_overlap)
    if a.command in ("index", "update"):
        print(index.index(gather(spark, a.data), a.force).summary())
    elif a.command == "dry-run":
        plan = index.dry_run(gather(spark, a.data))
        print(plan.summary())
        for kind, n in plan.files.items():
            if n:
                print(f"{kind}:", *plan.first(kind), *([f"... and {n - 10} more"] if n > 10 else []), sep="\n  ")
    elif a.command == "search":
        hits = Searcher(index.live(), catalog.repos(spark), config.embedding.model).search(a.query, a.limit, a.fork)
        for r in hits.select(shown_score(F.col("score")).alias("score"), "source", "section", preview(F.col("content")).alias("content")).collect():
            print(json.dumps(r.asDict(), ensure_ascii=False))
    elif a.command == "compile":
        specs = S.spec_files(spark, f"{a.data}/consensus-specs").withColumn("fork", fork_of_path(F.col("path"))).where("fork is not null")
        S.write_compiled(compile_specs(specs), f"{a.data}/compiled")
    elif a.command == "compile-clients":
        ready = [r for r in catalog.CLIENT_REPOS if r[3] in C.SUFFIXES and os.path.isdir(f"{a.data}/clients/{r[0]}")]
        if ready:
            code = S.union_sources(*[S.client_files(spark, f"{a.data}/clients/{r[0]}", r[0], r[3]) for r in ready])
            found = C.compile_clients(code)
            found.write.mode("overwrite").partitionBy("client").parquet(f"{a.data}/compiled/clients/items")
            C.name_index(found).write.mode("overwrite").partitionBy("client").parquet(f"{a.data}/compiled/clients/index")
            C.statistics(found).show(50, False)
    else:
        found, reason = index.manifest()
        files = found.files if found else {}
        n, chunks = files.totals() if isinstance(files, StoredFiles) else (len(files), sum(len(f.chunk_ids) for f in files.values()))
        print(json.dumps({"files": n, "chunks": chunks, "model": found.embedding_model if found else None, "reason": reason}))
        S.on_disk(spark, catalog.client_repos(spark).select("repo", "language", "layer"), f"{a.data}/clients").show(50, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
