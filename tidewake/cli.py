"""Command line: index, impact, diff, compile, blast and verify."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from tidewake import api
from tidewake.operators import closure, render, search, verify
from tidewake.operators import index as I
from tidewake.sources import stores


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidewake", description="What a change affects, and the context that shows it")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, text, *, ids=False, ref=False):
        c = sub.add_parser(name, help=text)
        c.add_argument("--repo", default=".")
        if ids:
            c.add_argument("--changed", nargs="+", help="changed ids, as ./pkg/mod.py:name")
        if ref:
            c.add_argument("--ref", help="take what changed since this commit")
        return c

    c = command("index", "count files, symbols and edges")
    c.add_argument("--cache")
    c = command("impact", "score what a change affects", ids=True)
    c.add_argument("--depth", type=int, default=2)
    c.add_argument("--verify", action="store_true", help="show the line that proves each edge")
    c = command("diff", "ids that changed since a commit")
    c.add_argument("ref", nargs="?", default="HEAD~1")
    c.add_argument("--committed-only", action="store_true")
    c = command("compile", "context of a change", ids=True, ref=True)
    c.add_argument("--depth", type=int, default=2)
    c.add_argument("--max-tokens", type=int, default=10_000, help="0: no bound")
    c.add_argument("--top-k", type=int, default=20, help="for each changed id; 0: no bound")
    c.add_argument("--graph-only", action="store_true")
    c.add_argument("--cutoff", choices=["topk", "gap"], default="topk")
    c.add_argument("--with-history", action="store_true")
    c.add_argument("--notes")
    c.add_argument("--json", action="store_true")
    c = command("blast", "tree of what depends on a change", ids=True, ref=True)
    c.add_argument("--depth", type=int, default=3)
    c = command("verify", "run cases; the exit code tells whether all pass")
    c.add_argument("--cases", required=True)
    c.add_argument("--cutoff", choices=["topk", "gap"], default=None)
    return p


def run_cases(ix: I.Index, cases, cutoff: str | None = None):
    """(name, recall, precision_lb, .., passed, score, verdict) of cases as ``stores.load_cases`` gives them; all of a group with equal limits at once."""
    cases = I.cut(cases.withColumn("query_id", F.col("name")))
    ids = lambda c: cases.select("query_id", F.explode(c).alias("id"))
    limits = cases.select("budget", "depth", "top_k").distinct().collect()
    picked = scores = None
    for m in limits:  # a few settings
        mine = cases.where((F.col("budget") == m.budget) & (F.col("depth") == m.depth) & (F.col("top_k") == m.top_k)).select("query_id")
        changed = ids("changed").join(mine, "query_id", "left_semi")
        s = I.impact(ix, changed, m.depth)
        p = I.compile_context(ix, s, changed, m.budget or None, m.top_k or None, cutoff).select("query_id", F.explode("ids").alias("id"))
        picked, scores = (p, s) if picked is None else (picked.unionByName(p), scores.unionByName(s))
    picked = I.cut(picked)
    r = verify.case_results(cases, ids("must_include"), ids("must_exclude"), ids("changed"), picked)
    q = verify.sufficiency(ix.edges, ix.symbols, scores, ids("changed"), picked, ix.broken.count())
    return r.join(q.select("query_id", "score", "verdict"), "query_id", "left")


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "diff":
        print(*api.diff(a.repo, a.ref, "HEAD" if a.committed_only else None), sep="\n")
        return 0
    if a.command == "compile":
        got = api.compile_context(a.changed, ref=a.ref, repo=a.repo, depth=a.depth, max_tokens=a.max_tokens, top_k=a.top_k, cutoff=a.cutoff, hybrid=not a.graph_only, with_history=a.with_history, notes=a.notes)
        print(json.dumps(got.__dict__, indent=2) if a.json else got.text)
        return 0 if got.text else 1
    ix = api.index(a.repo, getattr(a, "cache", None))
    if a.command == "index":
        print(f"files {ix.files.count()}\nsymbols {ix.symbols.count()}\nedges {ix.edges.count()}")
        for r in ix.broken.collect():
            print(f"doesn't parse: {r.file}: {r.problem}", file=sys.stderr)
        return 0
    if a.command == "verify":
        rows = run_cases(ix, stores.load_cases(ix.files.sparkSession, a.cases), a.cutoff).orderBy("query_id").collect()
        for r in rows:
            print(f"{'PASS' if r.passed else 'FAIL'}  {r.query_id}: recall {r.recall:.2f}, {r.n_missing} missing, {r.verdict} {r.score or 0:.0f}")
        return 0 if all(r.passed for r in rows) else 1
    changed = I.cut(api._changed(ix, a.changed, getattr(a, "ref", None)))
    for r in search.unknown_symbols(changed.select("id"), ix.symbols).collect():
        near = search.suggest_similar(ix.files.sparkSession.createDataFrame([(r.id,)], "id string"), ix.symbols).first()
        print(f"unknown: {r.id}" + (f"; is it {near.suggestion}?" if near else ""), file=sys.stderr)
    if a.command == "impact":
        for r in I.impact(ix, changed, a.depth).orderBy(F.desc("score"), "id").collect():
            print(f"{r.score:7.2f}  {r.id}")
        if a.verify:
            near = ix.edges.join(changed.select(F.col("id").alias("dst")), "dst", "left_semi")
            for r in render.proof_lines(near, ix.symbols).orderBy("dst", "src").collect():
                print(f"{r.src} -> {r.dst}: " + (f"line {r.line}: {r.text}" if r.text else "(no line of its own)"))
        return 0
    back = closure.reverse_graph(ix.edges)
    hops = I.cut(closure.min_hops(back, changed, a.depth))
    parents = hops.join(back, hops["id"] == back["src"]).select("query_id", F.col("dst").alias("id"), F.col("src").alias("parent"))
    for r in render.blast_tree(hops, parents).orderBy("query_id", "pos").collect():
        print(r.line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
