"""Context packages: symbol blocks, header and suggestions as text, within a budget."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.operators import scoring as S
from tidewake.operators.search import bare_name
from tidewake.runtime import arrow

BLIND_CAP, DROP_CAP, TIGHT_DROP_CAP, TIGHT = 25, 15, 5, 2000
OUTSIDE = " [NOT IN CONTEXT]"


def relationship_cap(budget: int | None) -> int:
    """Callers and callees that a block names: fewer under a tight budget."""
    return 3 if budget and budget < TIGHT else 6


def describe_scoring() -> str:
    """What the scores are made of, from the constants in use."""
    return (
        f"changed={S.CHANGED:.0f}, callees {S.FORWARD:.0f}*{S.FORWARD_DECAY}^hop, callers {S.BACKWARD:.0f}*{S.BACKWARD_DECAY}^hop, cutoff {S.CUTOFF:.0f}, {S.MAX_HOPS} hops, "
        f"siblings up to {S.SIBLING_CAP:.0f}, floor {S.FLOOR:.0f}, structure up to {S.STRUCTURE_CAP:.0f}"
    )


def _listed(names, total, cap: int, inside):
    """The first cap of sorted names, those outside marked, and how many more there are."""
    shown = F.transform(F.slice(names, 1, cap), lambda x: F.when(F.array_contains(inside, x), x).otherwise(F.concat(x, F.lit(OUTSIDE))))
    more = F.when(total > cap, F.array(F.concat(F.lit("... +"), (total - cap).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(shown, more), ", ")


def neighbours(edges: DataFrame, ids: DataFrame, cap: int = 6) -> DataFrame:
    """(id, callers, n_callers, callees, n_callees): the first cap of each by name, and how many there are.

    Names are ranked before they are gathered, so a hub's list is no longer than cap.
    """
    e, want = edges.select("src", "dst").distinct(), ids.select("id").distinct()

    def side(own, other, out):
        w = Window.partitionBy(own).orderBy(other)
        r = e.join(want.withColumnRenamed("id", own), own, "left_semi").withColumn("rn", F.row_number().over(w))
        return r.groupBy(F.col(own).alias("id")).agg(F.array_sort(F.collect_list(F.when(F.col("rn") <= cap, F.col(other)))).alias(out), F.count("*").alias(f"n_{out}"))

    out = want.join(side("dst", "src", "callers"), "id", "left").join(side("src", "dst", "callees"), "id", "left")
    return out.na.fill(0, ["n_callers", "n_callees"])


def relationship_blocks(edges: DataFrame, selected: DataFrame, cap: int = 6) -> DataFrame:
    """(query_id, id, block): callers and callees of the selected ids, those that aren't selected marked."""
    inside = selected.groupBy("query_id").agg(F.collect_set("id").alias("inside"))  # a query's selection is bounded by its budget
    n = selected.select("query_id", "id").distinct().join(neighbours(edges, selected, cap), "id").join(inside, "query_id")
    line = lambda label, c: F.when(F.col(f"n_{c}") > 0, F.concat(F.lit(f"{label}: "), _listed(F.col(c), F.col(f"n_{c}"), cap, F.col("inside")), F.lit("\n"))).otherwise("")
    none = (F.col("n_callers") == 0) & (F.col("n_callees") == 0)
    return n.select("query_id", "id", F.when(none, "CALLERS: (none found in repo)\nCALLEES: (none found in repo)\n").otherwise(F.concat(line("CALLERS", "callers"), line("CALLEES", "callees"))).alias("block"))


def symbol_blocks(symbols: DataFrame, scores: DataFrame, edges: DataFrame, selected: DataFrame, cap: int = 6) -> DataFrame:
    """(query_id, id, text): each selected symbol as it is shown."""
    s = symbols.select("id", "code")
    b = relationship_blocks(edges, selected, cap).join(scores.select("query_id", "id", "score"), ["query_id", "id"], "left").join(s, "id")
    head = F.concat(F.lit("FILE: "), F.substring_index("id", ":", 1), F.lit("\nFUNCTION: "), F.substr("id", F.instr("id", ":") + 1), F.lit(" (score: "), F.bround(F.coalesce("score", F.lit(0.0))).cast("long").cast("string"), F.lit(")\n"))
    return b.select("query_id", "id", F.concat(head, "block", F.lit("\n"), "code").alias("text"))


def proof_lines(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst, line, text): the first line of the caller that calls the callee by name; nulls without one."""
    code = symbols.select(F.col("id").alias("src"), "code", "lineno")
    e = edges.select("src", "dst").distinct().join(code, "src", "left")
    call = F.concat(bare_name(F.element_at(F.split("dst", ":"), -1)), F.lit("("))
    lines = F.split("code", r"\r\n|\r|\n")
    at = F.array_position(F.transform(lines, lambda x: x.contains(call)), F.lit(True))
    text = F.trim(F.get(lines, (at - 1).cast("int")))
    text = F.when(F.length(text) > 80, F.concat(F.substring(text, 1, 77), F.lit("..."))).otherwise(text)
    return e.select("src", "dst", F.when(at > 0, F.col("lineno") + at - 1).alias("line"), F.when(at > 0, text).alias("text"))


def blast_tree(hops: DataFrame, parents: DataFrame) -> DataFrame:
    """(query_id, pos, line): reached ids below the first of their parents one hop nearer, indented.

    hops(query_id, id, hops) with seeds at 0, parents(query_id, id, parent) the edges that reached them.
    """
    h = hops.select("query_id", F.col("id").alias("parent"), (F.col("hops") + 1).alias("hops"))
    up = parents.join(h, ["query_id", "parent"]).join(hops, ["query_id", "id", "hops"]).groupBy("query_id", "id", "hops").agg(F.min("parent").alias("parent"))
    rows = hops.where("hops = 0").select("query_id", "id", "hops", F.array("id").alias("path"))
    level, deepest = rows, hops.agg(F.max("hops")).first()[0] or 0
    for d in range(1, deepest + 1):
        level = level.select("query_id", F.col("id").alias("parent"), "path").join(up.where(F.col("hops") == d), ["query_id", "parent"]).select("query_id", "id", "hops", F.concat("path", F.array("id")).alias("path"))
        rows = rows.unionByName(level)
    line = F.concat(F.repeat(F.lit("   "), F.greatest(F.col("hops") - 1, F.lit(0))), F.when(F.col("hops") > 0, "└─ ").otherwise(""), "id")
    return rows.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("path")).alias("pos"), line.alias("line"))


def suggestions(changed_callers: list[tuple[str, int]], n_dropped: int, n_broken: int, confidence: float) -> str:
    tips = []
    if n_broken:
        tips.append(f"Mend the syntax of {n_broken} file(s): the graph has holes there.")
    if confidence < 0.7:
        tips.append(f"Graph confidence is {confidence * 100:.0f}%: add the sources of dependencies to the index.")
    tips += [f"'{name.split(':')[-1]}' has {n} callers, an unusually wide reach: review it with care." for name, n in changed_callers if n > 20]
    if n_dropped:
        tips.append(f"{n_dropped} symbol(s) didn't fit the budget: without one all are shown.")
    return "\n".join(["=== SUGGESTIONS ===", *(f"  {i}. {t}" for i, t in enumerate(tips, 1)), "=== END SUGGESTIONS ==="]) if tips else ""


def _render(items: list[dict], dropped: list[tuple[str, float]], n_dropped: int, facts: dict, budget: int | None, notes: str | None) -> str:
    """The text of one package; {TOKENS} stands for its own length."""
    cap, inside = relationship_cap(budget), {x["id"] for x in items}

    def names(label, shown, n):
        if not n:
            return ""
        parts = [x if x in inside else x + OUTSIDE for x in shown[:cap]] + ([f"... +{n - cap} more"] if n > cap else [])
        return f"{label}: {', '.join(parts)}\n"

    def block(x):
        rel = names("CALLERS", x["callers"] or [], x["n_callers"]) + names("CALLEES", x["callees"] or [], x["n_callees"])
        file, _, name = x["id"].partition(":")
        return f"FILE: {file}\nFUNCTION: {name} (score: {x['score']:.0f})\n{rel or 'CALLERS: (none found in repo)' + chr(10) + 'CALLEES: (none found in repo)' + chr(10)}\n{x['code']}"

    body = []
    for label, role in (("CHANGED", "changed"), ("IMPACTED", "impacted"), ("DEPENDENCIES", "dependency")):
        if mine := [block(x) for x in items if x["role"] == role]:
            body += [f"=== {label} SYMBOLS ===\n", "\n\n---\n\n".join(mine)]
    code = "\n\n".join(body)
    changed = [x for x in items if x["role"] == "changed"]
    c = facts["confidence"]
    lines = [
        "=== CONTEXT META ===", f"Repo symbols total    : {facts['n_symbols']}", f"Symbols scored        : {facts['n_scored']}", f"Symbols IN context    : {len(items)}", f"Symbols DROPPED       : {n_dropped}  (not visible below)",
        f"Graph edges total     : {facts['n_edges']}", f"Graph confidence      : {c * 100:.0f}%" + ("" if c >= 0.9 else "  (incomplete)"),
        "Note: confidence tells of structure only; code that belongs together without calls may be missing from all lists here.",
        f"Changed symbols       : {facts['n_changed']}", f"Direct callers found  : {sum(x['n_callers'] for x in changed)}", f"Direct callees found  : {sum(x['n_callees'] for x in changed)}",
        f"Context tokens (code) : {max(1, len(code) // 4):,}", "Output tokens (full)  : {TOKENS}", f"Scoring basis         : {describe_scoring()}", "", "=== MODULES ===",
    ]
    loaded = {}
    for x in items:
        loaded[x["id"].partition(":")[0]] = loaded.get(x["id"].partition(":")[0], 0) + 1
    modules = {m["file"]: m for m in facts["modules"]}
    doc = lambda m: f": {m['doc']}" if m.get("doc") else ""
    own = [f"  - {f} ({n}/{modules[f]['total']} symbols loaded){doc(modules[f])}" for f, n in sorted(loaded.items()) if f in modules]
    blind = [f"  - {f} ({m['total']} symbols){doc(m)}" for f, m in sorted(modules.items()) if f not in loaded]
    n_blind = facts["n_modules"] - len(own)
    size = (facts["module_chars"] + sum(map(len, own))) // 4
    if budget is not None and size > max(budget // 4, 150):
        lines.append(f"{facts['n_modules']} files: {len(own)} in context, {n_blind} not (lists left out under a tight budget)")
    else:
        lines += ["IN CONTEXT:", *(own or ["  (none)"]), "", "NOT IN CONTEXT:", *(blind[:BLIND_CAP] or ["  (none)"])]
        if n_blind > BLIND_CAP:
            lines.append(f"  ... and {n_blind - BLIND_CAP} more modules")
    if facts["broken"] or facts["n_broken"]:
        lines += ["", f"FILES THAT DON'T PARSE ({facts['n_broken']}):", *(f"  - {f}" for f in facts["broken"])]
    if n_dropped:
        most = TIGHT_DROP_CAP if budget and budget < TIGHT else DROP_CAP
        lines += ["", f"DROPPED SYMBOLS ({n_dropped}), scored but cut:", *(f"  - {d}  (score: {s:.0f})" for d, s in dropped[:most])]
        if n_dropped > most:
            lines.append(f"  ... and {n_dropped - most} more")
    if notes:
        lines += ["", "=== NOTES ===", notes]
    lines.append("=== END META ===")
    tips = suggestions([(x["id"], x["n_callers"]) for x in changed], n_dropped, facts["n_broken"], c)
    return "\n".join(lines) + "\n\n" + code + (f"\n\n{tips}" if tips else "")


def fitted(items: list[dict], dropped: list[tuple[str, float]], n_dropped: int, facts: dict, budget: int | None, notes: str | None = None, count=None) -> tuple[str, int, list[dict], list[tuple[str, float]], int]:
    """(text, tokens, items, dropped, n_dropped): the lowest-scored items that didn't change go until the text fits."""
    count = count or (lambda text: max(1, len(text) // 4))
    items = list(items)
    while True:
        raw = _render(items, dropped, n_dropped, facts, budget, notes)
        tokens = count(raw.replace("{TOKENS}", "0", 1))
        for _ in range(3):
            text = raw.replace("{TOKENS}", f"{tokens:,}", 1)
            if count(text) == tokens:
                break
            tokens = count(text)
        rest = sorted((x for x in items if x["role"] != "changed"), key=lambda x: (x["score"], x["id"]))
        if budget is None or tokens <= budget or not rest:
            return text, tokens, items, dropped, n_dropped
        over, gone = tokens - budget, []
        for x in rest:
            gone.append(x)
            over -= count(x["code"]) + 20
            if over <= 0:
                break
        out = {x["id"] for x in gone}
        items = [x for x in items if x["id"] not in out]
        dropped, n_dropped = sorted(((x["id"], x["score"]) for x in gone), key=lambda p: (-p[1], p[0])) + dropped, n_dropped + len(gone)


def compile_context(symbols: DataFrame, edges: DataFrame, scores: DataFrame, roles: DataFrame, broken: DataFrame, budget: int | None = None, notes: str | None = None, docs: DataFrame | None = None) -> DataFrame:
    """(query_id, text, tokens, total_repo_tokens, ids, dropped): a package a query.

    roles(query_id, id, role) are from ``select_context``; docs(file, doc) have first lines
    of modules. What a query needs is gathered in one row: its selection, which the budget
    bounds, and the first of what it drops; it is put together there.
    """
    s = symbols.select("id", "code", F.substring_index("id", ":", 1).alias("file"))
    sc = scores.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    kept = roles.where("role <> 'dropped'").join(s, "id").join(sc, ["query_id", "id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    role = F.when(F.col("role") == "changed", "changed").when(F.col("score") >= 70, "impacted").otherwise("dependency")
    kept = kept.withColumn("role", role).join(neighbours(edges, kept, relationship_cap(budget)), "id")
    item = F.struct((-F.col("score")).alias("o"), "id", "role", "score", "code", "callers", "n_callers", "callees", "n_callees")
    a = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    d = roles.where("role = 'dropped'").join(sc, ["query_id", "id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    d = d.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    b = d.groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(F.col("rn") <= DROP_CAP, F.struct("rn", "id", "score")))).alias("dropped"), F.count("*").alias("n_dropped"))
    n = sc.groupBy("query_id").agg(F.count("*").alias("n_scored"))
    ch = roles.where("role = 'changed'").groupBy("query_id").agg(F.count("*").alias("n_changed"))
    totals = s.agg(F.count("*").alias("n_symbols"), F.coalesce(F.floor((F.sum(F.length("code")) + 2 * F.greatest(F.count("*") - 1, F.lit(0))) / 4), F.lit(0)).alias("repo_tokens")).first()
    e = edges.select("src", "dst").distinct()
    known = e.join(s.select(F.col("id").alias("dst"), F.lit(1).alias("known")), "dst", "left").agg(F.count("*").alias("n"), F.count("known").alias("k")).first()
    modules = s.groupBy("file").agg(F.count("*").alias("total"))
    modules = modules.join(docs.select("file", "doc").dropDuplicates(["file"]), "file", "left") if docs is not None else modules.withColumn("doc", F.lit(None).cast("string"))
    widths = modules.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("file") + 16 + F.coalesce(F.length("doc"), F.lit(0))), F.lit(0)).alias("chars")).first()
    first = modules.orderBy("file").limit(BLIND_CAP + 200).select(F.struct("file", "total", "doc").alias("m"))  # what a list can show
    files = kept.select("query_id", "file").distinct().join(modules, "file").groupBy("query_id").agg(F.collect_list(F.struct("file", "total", "doc")).alias("mine"))
    head = [r.m.asDict() for r in first.collect()]
    bad, n_bad = [r.file for r in broken.select("file").distinct().orderBy("file").limit(50).collect()], broken.select("file").distinct().count()
    facts = {"n_symbols": totals.n_symbols, "n_edges": known.n, "confidence": known.k / known.n if known.n else 1.0, "n_modules": widths.n, "module_chars": int(widths.chars), "broken": bad, "n_broken": n_bad}
    rows, repo_tokens = a, totals.repo_tokens
    for part in (b, n, ch, files):
        rows = rows.join(part, "query_id", "left")

    def put_together(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                mine = facts | {"n_scored": r["n_scored"] or 0, "n_changed": r["n_changed"] or 0, "modules": list({m["file"]: m for m in [*head, *(r["mine"] or [])]}.values())}
                text, tokens, items, gone, n_gone = fitted(r["items"], [(x["id"], x["score"]) for x in r["dropped"] or []], r["n_dropped"] or 0, mine, budget, notes)
                out.append((r["query_id"], text, tokens, repo_tokens, [x["id"] for x in items], [x for x, _ in gone]))
            if out:
                types = (batch.schema.field("query_id").type, pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["query_id", "text", "tokens", "total_repo_tokens", "ids", "dropped"])

    kind = rows.schema["query_id"].dataType.simpleString()
    return arrow(rows, put_together, f"query_id {kind}, text string, tokens long, total_repo_tokens long, ids array<string>, dropped array<string>")
