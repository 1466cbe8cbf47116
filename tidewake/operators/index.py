"""An index of a repository: its files, facts, symbols and graph, and what follows from a change."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.operators import blend, closure, diff, history, render, resolve, scoring, script_graph, search, select, text
from tidewake.runtime import cut
from tidewake.sources import files as S
from tidewake.sources import git
from tidewake.sources.stores import FactCache

KEYS = ["query_id", "id"]


@dataclass(frozen=True)
class Index:
    """A snapshot; an update makes another one."""

    root: str
    files: DataFrame
    facts: DataFrame
    symbols: DataFrame
    edges: DataFrame

    @property
    def broken(self) -> DataFrame:
        """(file, problem) of files that don't parse, each once."""
        return S.once(self.facts.where("kind = 'broken'").select("file", F.col("name").alias("problem")), "file")

    @property
    def encoding(self) -> DataFrame:
        return self.facts.where("kind = 'encoding'").select("file").distinct()

    @property
    def docs(self) -> DataFrame:
        return self.facts.where("kind = 'doc'").select("file", F.col("code").alias("doc"))


def _built(root: str, files: DataFrame, facts: DataFrame, edges: DataFrame | None = None) -> Index:
    facts = cut(facts)
    symbols = cut(resolve.symbols(facts))
    return Index(root, files, facts, symbols, cut(_graph(facts, files)) if edges is None else edges)


def _graph(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Edges of Python files, and of scripts where there are any."""
    python = resolve.repository_edges(facts.where("file like '%.py'"), files)
    scripts = facts.where("file not like '%.py'")
    return python if scripts.isEmpty() else python.unionByName(script_graph.script_edges(scripts, files))


def index_repository(spark: SparkSession, root: str, cache: str | None = None) -> Index:
    """Index the source files below root. With a cache folder only files of new content are parsed, and a known state's graph is read."""
    files = cut(S.discover(spark, root))
    if cache is None:
        return _built(root, files, resolve.extract_facts(files))
    store = FactCache(cache)
    facts, _ = store.facts(files)
    state = S.state_hash(files).first().state
    known = store.get_graph(spark, state)
    index = _built(root, files, facts, known)
    if known is None:
        store.put_graph(index.edges, state)
    return index


def normalised(root: str, paths: list[str]) -> list[str]:
    """Paths as ``./pkg/mod.py``, whether given absolute or below root."""
    top = os.path.abspath(root)
    return sorted({"./" + os.path.relpath(p if os.path.isabs(p) else os.path.join(top, p), top) for p in paths})


def update_index(index: Index, changed: list[str], files: DataFrame | None = None) -> Index:
    """The index after a change of some files: only those are read and parsed again, deleted ones go.

    Imports, types and edges are resolved anew from all facts, as an added or removed
    module may change what other files' names mean. files, if given, are the new contents
    of the changed files (others are ignored); without it they are read from root.
    """
    spark = index.files.sparkSession
    names = normalised(index.root, changed)
    gone = spark.createDataFrame([(n,) for n in names], "rel_file string")
    fresh = (S.discover(spark, index.root) if files is None else files).join(gone, "rel_file", "left_semi")
    fresh = cut(fresh.select("rel_file", "content"))
    kept = index.files.select("rel_file", "content").join(gone, "rel_file", "left_anti")
    facts = index.facts.join(gone.withColumnRenamed("rel_file", "file"), "file", "left_anti").select(*index.facts.columns)
    return _built(index.root, cut(kept.unionByName(fresh)), facts.unionByName(resolve.extract_facts(fresh)))


def find_changed(index: Index, ref: str = "HEAD~1", against: str | None = None) -> DataFrame:
    """(id): symbols that the change since ref touches, ids that are gone, and prior ids of files that no longer parse."""
    spark = index.files.sparkSession
    changed = git.changed_files(spark, index.root, ref, against)
    hunks = git.hunks(git.patches(changed, index.root, ref, against, 0))
    s = index.symbols.select("file", "id", F.col("lineno").alias("start"), "end")
    touched = diff.touched_symbols(s.join(changed.withColumnRenamed("rel_file", "file"), "file", "left_semi"), hunks)
    before = git.blobs(changed.select(F.lit(ref).alias("commit"), "rel_file"), index.root).where("content is not null")
    prior = resolve.symbols(resolve.extract_facts(before.select("rel_file", "content"))).select("id", "file")
    broken = index.broken.select("file")
    return diff.changed_symbols(touched, prior.join(broken, "file", "left_anti"), index.symbols, broken.limit(0)).union(prior.join(broken, "file", "left_semi").select("id")).distinct()


def impact(index: Index, changed: DataFrame, depth: int = 2, hybrid: bool = True, with_history: bool = False) -> DataFrame:
    """(query_id, id, score) of changed(query_id, id): graph scores, blended with text, files and history on request."""
    graph = cut(scoring.impact_scores(index.edges, changed, depth))
    known = changed.join(index.symbols.select("id"), "id", "left_semi").select(*KEYS)
    if not hybrid:
        return graph
    code = index.symbols.select("id", "code", "file")
    asked = known.join(code, "id").select(F.concat_ws("\0", "query_id", "id").alias("query_id"), F.col("code").alias("text"))
    lex = text.bm25(code, asked).withColumn("query_id", F.split("query_id", "\0")[0]).groupBy(*KEYS).agg(F.max("score").alias("score"))
    lex = lex.withColumn("query_id", F.col("query_id").cast(changed.schema["query_id"].dataType))
    past = None
    if with_history:
        log = git.history(index.files.sparkSession, index.root).select("commit", "file")
        mine = known.join(code, "id").select("query_id", "file").distinct()
        past = search.scores_for_symbols(code, history.scores_for_files(log, mine))
    return cut(blend.hybrid(graph, lex, search.same_file(code, known), None, past, known))


def compile_context(index: Index, scores: DataFrame, changed: DataFrame, budget: int | None = 10_000, top_k: int | None = 20, cutoff: str | None = None, notes: str | None = None) -> DataFrame:
    """The package of each query; top_k counts for each changed id of a query that has the most of them."""
    if cutoff not in (None, "topk", "gap"):
        raise ValueError(f"unknown cutoff: {cutoff!r}")
    most = changed.groupBy("query_id").count().agg(F.max("count")).first()[0] or 1
    cost = F.greatest(F.lit(1), F.floor((F.length("code") + 160) / 4 * 1.2)).cast("long")  # with a block's head and relations
    c = scores.join(index.symbols.select("id", cost.alias("cost")), "id")
    known = changed.join(index.symbols.select("id"), "id", "left_semi")
    roles = cut(select.select_context(c, known, budget, None if not top_k else top_k * most, cutoff == "gap"))
    return render.compile_context(index.symbols, index.edges, scores, roles, index.broken, budget, notes, index.docs)


def blast(index: Index, changed: DataFrame, depth: int = 3) -> DataFrame:
    """(query_id, id, hops) of what depends on the changed ids, within depth."""
    return closure.blast_radius(index.edges, changed, depth)
