"""The service's tools: validated requests in, plain rows out; errors are returned, not raised."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog
from ..functions.text import shown_share
from ..operators.specs import function_source, grep_constant
from . import validation as V
from .grams import GramIndex
from .incremental import Index
from .search import Searcher, top_k


def fork_list(spark: SparkSession) -> DataFrame:
    return catalog.forks(spark).orderBy("ordinal").select("name", "epoch", "date", "description", "current")


def current_fork(spark: SparkSession) -> DataFrame:
    return fork_list(spark).where("current")


def client_list(spark: SparkSession, layer: str | None = None) -> DataFrame:
    rows = catalog.clients(spark)
    rows = rows.where(F.col("layer") == layer) if layer else rows
    return rows.orderBy("ordinal").select("name", "layer", "language", "organization", shown_share(F.col("node_percentage"), F.col("stake_percentage")).alias("percentage"), "mainnet_status")


def clients_named(clients: DataFrame, parts: DataFrame) -> DataFrame:
    """(part, client's columns): for each distinct part the first client whose name holds it, in any case. Clients are few: they go to the tasks."""
    asked = parts.select("part").where("part is not null").distinct()
    found = asked.join(F.broadcast(clients), F.contains(F.lower("name"), F.lower("part")))
    return found.groupBy("part").agg(F.min_by(F.struct(*clients.columns), "ordinal").alias("c")).select("part", "c.*")


def client_named(spark: SparkSession, name: str) -> DataFrame:
    """The first client whose name holds the text."""
    rows = clients_named(catalog.clients(spark), spark.createDataFrame([(name,)], "part string"))
    return rows.withColumn("percentage", shown_share(F.col("node_percentage"), F.col("stake_percentage"))).drop("ordinal", "part")


def with_risk(rows: DataFrame, limit: float = catalog.SUPERMAJORITY) -> DataFrame:
    """Adds the largest share of each layer to rows (layer, percentage, ...), and whether it is a supermajority."""
    layers = rows.groupBy("layer").agg((F.max("percentage") > limit).alias("supermajority_risk"), F.max("percentage").alias("largest_share"))
    return rows.join(layers, "layer")


def client_diversity(spark: SparkSession) -> DataFrame:
    """Each client's share of its layer and whether a client holds a supermajority of it."""
    return with_risk(client_list(spark).select("name", "layer", "language", "percentage")).select("name", "layer", "language", "percentage", "supermajority_risk", "largest_share")


def client_pairs(spark: SparkSession) -> DataFrame:
    return catalog.pairs(spark).orderBy("ordinal").select("pair", "notes")


def guidance_of(entries: DataFrame, topics: DataFrame) -> DataFrame:
    """(topic, entry's columns) for each distinct topic of topics (topic): the entry of that key, else the first whose key holds the topic, is held by it, or whose summary holds it.

    Entries are few: they go to the tasks that have the topics.
    """
    asked = topics.select("topic").where("topic is not null").distinct().select(F.col("topic").alias("asked"), F.lower("topic").alias("_t"))
    t = F.col("_t")
    rank = F.when(F.col("key") == t, 0).when(F.contains("key", t) | F.contains(t, F.col("key")) | F.contains(F.lower("summary"), t), 1)
    found = asked.crossJoin(F.broadcast(entries)).withColumn("_rank", rank).where("_rank is not null")
    best = found.groupBy("asked").agg(F.min_by(F.struct(*entries.columns), F.struct("_rank", "ordinal")).alias("e"))
    return best.select("asked", "e.*")


def guidance_for(entries: DataFrame, topic: str) -> DataFrame:
    """The entry of one topic, if there is one."""
    return guidance_of(entries, entries.sparkSession.createDataFrame([(topic,)], "topic string")).drop("asked", "ordinal")


def with_guidance(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Entries with others added; an entry of the same topic (in lower case) is replaced where it stands."""
    new = new.withColumn("key", F.lower("topic"))
    base = entries.agg(F.coalesce(F.max("ordinal"), F.lit(-1)).alias("_last"))
    places = entries.select("key", F.col("ordinal").alias("_at"))
    added = new.drop("ordinal").join(places, "key", "left").crossJoin(F.broadcast(base)).withColumn("ordinal", F.coalesce("_at", F.col("_last") + 1)).drop("_at", "_last")
    return entries.join(new.select("key"), "key", "left_anti").unionByName(added)


def answered(tool: Callable) -> Callable:
    @wraps(tool)
    def run(*args, **kwargs):
        try:
            return tool(*args, **kwargs)
        except V.RequestError as e:
            return [{"error": str(e)}]

    return run


class Service:
    """Tools over an index, its compiled specs and its spec files (fork, path, content)."""

    def __init__(self, spark: SparkSession, index: Index, compiled: DataFrame | None = None, specs: DataFrame | None = None, grams: GramIndex | None = None):
        self.spark, self.index, self.compiled, self.specs, self.grams = spark, index, compiled, specs, grams
        self.guidance = catalog.guidance(spark)

    def searcher(self, prefilter: bool = True) -> Searcher:
        """Encodes with the model that the index was built with."""
        found, _ = self.index.manifest()
        return Searcher(self.index.live(), catalog.repos(self.spark), found.embedding_model if found else self.index.model, prefilter)

    @staticmethod
    def _rows(df: DataFrame) -> list[dict]:
        return [r.asDict(recursive=True) for r in df.collect()]

    @answered
    def search(self, query: str, fork: str | None = None, limit: int = 5, include_lean_spec: bool = False) -> list[dict]:
        found = self.searcher().combined(V.query(query), V.fork(fork) or catalog.CURRENT_FORK, V.limit(limit), include_lean_spec)
        return self._rows(found)

    @answered
    def search_specs(self, query: str, fork: str | None = None, limit: int = 5) -> list[dict]:
        return self._rows(self.searcher().search_specs(V.query(query), V.fork(fork), V.limit(limit)))

    @answered
    def search_eip(self, query: str, eip_number: str | None = None, limit: int = 5) -> list[dict]:
        return self._rows(self.searcher().search_eip(V.query(query), V.eip(eip_number), V.limit(limit)))

    @answered
    def search_lean_spec(self, query: str, limit: int = 5) -> list[dict]:
        return self._rows(self.searcher().search_lean(V.query(query), V.limit(limit)))

    @answered
    def search_lean_pq(self, query: str, limit: int = 5, repo: str | None = None) -> list[dict]:
        return self._rows(self.searcher().search_pq(V.query(query), V.limit(limit), V.pq_repo(repo)))

    @answered
    def grep_constant(self, name: str, fork: str | None = None) -> list[dict]:
        """The compiled value; else the nearest constant chunk whose content holds the name: of all of them by the gram index, where there is one, else of ten hits."""
        name, fork = V.constant(name), V.fork(fork) or catalog.CURRENT_FORK
        if self.compiled is not None and (exact := self._rows(grep_constant(self.compiled, name, fork))):
            return exact
        if self.grams is None:
            return self._rows(top_k(self.searcher().search_constant(name).where(F.contains(F.lower("content"), F.lit(name.lower()))), 1))
        found, _ = self.index.manifest()
        self.grams.refresh(found.commit)
        held = self.grams.rows(name, found.commit, F.col("chunk_type") == "constant")
        return self._rows(Searcher(held, catalog.repos(self.spark), found.embedding_model).search(f"{name} constant value", 1))

    @answered
    def analyze_function(self, name: str, fork: str | None = None) -> list[dict]:
        name, fork = V.function(name), V.fork(fork) or catalog.CURRENT_FORK
        if self.specs is not None and (exact := self._rows(function_source(self.specs, name, fork))):
            return exact
        return self._rows(top_k(self.searcher().search_function(name, fork), 1))

    def list_forks(self) -> list[dict]:
        return self._rows(fork_list(self.spark))

    def get_current_fork(self) -> list[dict]:
        return self._rows(current_fork(self.spark))

    @answered
    def expert_guidance(self, topic: str) -> list[dict]:
        found = self._rows(guidance_for(self.guidance, V.topic(topic)))
        return found or [{"error": f"No guidance for '{topic}'", "topics": [r["key"] for r in self.guidance.orderBy("ordinal").collect()]}]

    def add_guidance(self, entry: DataFrame) -> None:
        self.guidance = with_guidance(self.guidance, entry)

    @answered
    def list_clients(self, layer: str | None = None) -> list[dict]:
        return self._rows(client_list(self.spark, V.layer(layer)))

    @answered
    def get_client(self, name: str) -> list[dict]:
        found = self._rows(client_named(self.spark, V.client(name)))
        return found or [{"error": f"No client '{name}'", "available": [c[0] for c in catalog.CLIENTS]}]

    def get_client_diversity(self) -> list[dict]:
        return self._rows(client_diversity(self.spark))

    def get_recommended_client_pairs(self) -> list[dict]:
        return self._rows(client_pairs(self.spark))

    def get_spec_version(self) -> dict:
        found, reason = self.index.manifest()
        return {"forks": catalog.FORK_NAMES, "current_fork": catalog.CURRENT_FORK, "index_exists": self.index.table.exists(), "repo_versions": found.repo_versions if found else {}, "updated_at": found.updated_at if found else None, "reason": reason}

    def health(self) -> dict:
        """Unhealthy if the index is missing or a probe fails; missing specs do not count."""
        out = {"index": self.index.table.exists(), "compiled": self.compiled is not None, "specs": self.specs is not None, "query": False}
        if out["index"]:
            try:
                Searcher(self.index.live().limit(1), catalog.repos(self.spark), self.index.model).search("probe", 1).collect()  # a row shows that it can be read and scored
                out["query"] = True
            except Exception as e:  # whatever it is, health reports it
                out["error"] = str(e)[:200]
        return out | {"healthy": out["index"] and out["query"]}


def safe_path(base: str, *parts: str) -> str:
    """A path below ``base``; ValueError for one that leaves it."""
    root = os.path.realpath(base)
    path = os.path.realpath(os.path.join(root, *parts))
    if path != root and not path.startswith(root + os.sep):
        raise ValueError(f"{'/'.join(parts)} leaves {base}")
    return path
