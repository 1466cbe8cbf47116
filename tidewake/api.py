"""What a change affects, in a call: blast_radius, index, diff and compile_context."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tidewake.operators import closure
from tidewake.operators import index as I


@dataclass
class BlastResult:
    changed: list[str] = field(default_factory=list)
    callers: list[str] = field(default_factory=list)
    dependencies: list[str] = field(default_factory=list)
    scores: dict[str, float] = field(default_factory=dict)

    @property
    def total_affected(self) -> int:
        return len({*self.changed, *self.callers, *self.dependencies, *self.scores})


@dataclass
class Package:
    text: str = ""
    tokens: int = 0
    total_repo_tokens: int = 0
    ids: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)

    @property
    def reduction_pct(self) -> float:
        return 100.0 * (1 - self.tokens / self.total_repo_tokens) if self.total_repo_tokens else 0.0


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def index(repo: str = ".", cache: str | None = None) -> I.Index:
    return I.index_repository(session(), repo, cache)


def _changed(ix: I.Index, symbol: str | list[str] | None, ref: str | None) -> DataFrame:
    spark = ix.files.sparkSession
    if symbol:
        ids = [(0, x) for x in ([symbol] if isinstance(symbol, str) else symbol)]
        return spark.createDataFrame(ids, "query_id int, id string")
    return I.find_changed(ix, ref or "HEAD~1").selectExpr("0 as query_id", "id")


def diff(repo: str = ".", ref: str = "HEAD~1", against: str | None = None) -> list[str]:
    """The ids that a change touches."""
    return sorted(r.id for r in I.find_changed(index(repo), ref, against).collect())


def blast_radius(symbol: str | list[str] | None = None, *, ref: str | None = None, repo: str = ".", depth: int = 3) -> BlastResult:
    """What one change (ids, or all since ref) affects; the result is one query's, and is given whole."""
    ix = index(repo)
    changed = I.cut(_changed(ix, symbol, ref))
    ids = sorted(r.id for r in changed.collect())
    if not ids:
        return BlastResult()
    callers = sorted(r.id for r in closure.blast_radius(ix.edges, changed).collect())
    seeds = changed.union(ix.files.sparkSession.createDataFrame([(0, x) for x in callers], "query_id int, id string"))
    deps = sorted(r.id for r in closure.expand_dependencies(ix.edges, seeds, depth).collect())
    return BlastResult(ids, callers, [d for d in deps if d not in set(ids)], {r.id: r.score for r in I.impact(ix, changed, depth).collect()})


def compile_context(symbol: str | list[str] | None = None, *, ref: str | None = None, repo: str = ".", depth: int = 2, max_tokens: int | None = 10_000, top_k: int | None = 20, cutoff: str | None = None, hybrid: bool = True, with_history: bool = False, notes: str | None = None) -> Package:
    """A change's context as one text of at most max_tokens, or what its changed ids and the header take."""
    ix = index(repo)
    changed = I.cut(_changed(ix, symbol, ref))
    if changed.isEmpty():
        return Package()
    scores = I.impact(ix, changed, depth, hybrid, with_history)
    r = I.compile_context(ix, scores, changed, max_tokens or None, top_k or None, cutoff, notes).first()
    return Package(r.text, r.tokens, r.total_repo_tokens, r.ids, r.dropped) if r else Package()
