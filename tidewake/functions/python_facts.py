"""Facts of Python source files: one parse a file, one row a fact.

Rows are tagged by kind; what a column holds depends on it:

symbol: name (qualified by classes), lineno, end, code, doc
func: owner (the function), cls       deco: owner, cls, ord, path of the decorator
call, ref: owner, cls, ord, path of the callee or of a function passed as an argument;
    flag tells that the path's root is a typed local, of type (qualifier, name)
import: cls (from, plain or dotted), qualifier (the module), name, level, local, ord
class: name                           base: owner (the class), qualifier, name, ord
factory, var, attr: owner and its type (qualifier, name)
doc: code (the module's first docstring line)
broken: name (what the parser says)   encoding: a file that isn't UTF-8
"""

from __future__ import annotations

import ast
from collections import deque

import pyarrow as pa

from tidewake.functions import script_facts

COLUMNS = ("kind", "file", "owner", "cls", "qualifier", "name", "local", "ord", "level", "lineno", "end", "flag", "path", "code", "doc")
SCHEMA = "kind string, file string, owner string, cls string, qualifier string, name string, local string, ord int, level int, lineno int, end int, flag boolean, path array<string>, code string, doc string"
_ARROW = [pa.string()] * 7 + [pa.int32()] * 4 + [pa.bool_(), pa.list_(pa.string()), pa.string(), pa.string()]
_DEF = (ast.FunctionDef, ast.AsyncFunctionDef)
_PLAIN_TYPES = frozenset("str int float bool bytes None list dict set tuple Any Optional List Dict Set Tuple Iterator Generator Iterable Sequence Mapping Type Union".split())


def _blocks(node):
    """The statement lists of a compound statement."""
    for field in ("body", "handlers", "orelse", "finalbody", "cases"):
        yield from getattr(node, field, None) or ()


def _definitions(body, classes=(), everywhere=True):
    """(class stack, function) in source order; everywhere: also below if, try, with and match."""
    for node in body:
        if isinstance(node, _DEF):
            yield classes, node
            yield from _definitions(node.body, classes, everywhere)
        elif isinstance(node, ast.ClassDef):
            yield from _definitions(node.body, (*classes, node.name), everywhere)
        elif everywhere:
            yield from _definitions(_blocks(node), classes, everywhere)


def _statements(body):
    """Statements in order, those of if, loops, with and try included."""
    for s in body:
        yield s
        if isinstance(s, ast.If | ast.For | ast.AsyncFor | ast.While | ast.With | ast.AsyncWith | ast.Try):
            yield from _statements([x for x in _blocks(s) if not isinstance(x, ast.ExceptHandler)] if not isinstance(s, ast.Try) else _of_try(s))


def _of_try(s):
    return [*s.body, *(x for h in s.handlers for x in h.body), *s.orelse, *s.finalbody]


def _path(expr) -> list[str] | None:
    """The names of a.b.c; None if its root isn't a name."""
    out = []
    while isinstance(expr, ast.Attribute):
        out.append(expr.attr)
        expr = expr.value
    return [expr.id, *reversed(out)] if isinstance(expr, ast.Name) else None


def _type_ref(expr, deep=True):
    """(qualifier, name) of Name or a.Name; of x.y.Name too, without qualifier, if deep."""
    if isinstance(expr, ast.Name):
        return None, expr.id
    if isinstance(expr, ast.Attribute):
        return (expr.value.id, expr.attr) if isinstance(expr.value, ast.Name) else (None, expr.attr) if deep else None
    return None


def _annotation(expr):
    while isinstance(expr, ast.Subscript):
        expr = expr.slice
    return _type_ref(expr, deep=False)


def _value_type(value, known):
    """The type that a value tells: of a call its callee, of a name what it has, of `a or B()` the call's."""
    if isinstance(value, ast.Call):
        return _type_ref(value.func)
    if isinstance(value, ast.Name):
        return known.get(value.id)
    if isinstance(value, ast.BoolOp):
        told = [(isinstance(v, ast.Call), ref) for v in value.values if (ref := _value_type(v, known))]
        return next((ref for call, ref in told if call), told[0][1] if told else None)
    return None


def _parameters(fn):
    a = fn.args
    return {p.arg for p in (*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg)))}


def _typed_parameters(fn):
    return {p.arg: ref for p in fn.args.args if p.annotation is not None and (ref := _annotation(p.annotation))}


def _locals(fn):
    """Types of a function's parameters and variables; the last assignment counts."""
    given, found = _typed_parameters(fn), {}
    for s in _statements(fn.body):
        if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name):
            if ref := _annotation(s.annotation):
                found[s.target.id] = ref
        elif isinstance(s, ast.Assign) and (ref := _value_type(s.value, found | given)):
            found.update((t.id, ref) for t in s.targets if isinstance(t, ast.Name))
    return given | found


def _returned(fn):
    """The one type that all returns construct, else that of the annotation."""
    refs = []
    for s in _statements(fn.body):
        if isinstance(s, ast.Return) and s.value is not None:
            refs.append(_type_ref(s.value.func) if isinstance(s.value, ast.Call) else None)
    if refs and None not in refs and len(set(refs)) == 1:
        return refs[0]
    ref = _annotation(fn.returns) if fn.returns is not None else None
    return None if ref is None or ref[1] in _PLAIN_TYPES else ref


def _attributes(cls):
    """{attribute: type} of self.x that a class's methods assign."""
    out = {}
    for fn in cls.body:
        if not isinstance(fn, _DEF):
            continue
        given, found = _typed_parameters(fn), {}
        for s in _statements(fn.body):
            if isinstance(s, ast.AnnAssign):
                targets, ref = [s.target], _annotation(s.annotation)
            elif isinstance(s, ast.Assign):
                targets, ref = s.targets, _value_type(s.value, found | given)
            else:
                continue
            for t in targets if ref else ():
                if isinstance(t, ast.Name):
                    found[t.id] = ref
                elif isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self":
                    out[t.attr] = ref
    return out


def _imports(tree):
    """(kind, module, name, level, local) in breadth-first order."""
    queue = deque(tree.body)
    while queue:
        node = queue.popleft()
        if isinstance(node, ast.ImportFrom):
            yield from (("from", node.module or "", a.name, node.level, a.asname or a.name) for a in node.names)
        elif isinstance(node, ast.Import):
            for a in node.names:
                top = a.name if a.asname else a.name.split(".")[0]
                yield "plain", top, None, 0, a.asname or top
                if not a.asname and "." in a.name:
                    yield "dotted", a.name, None, 0, a.name
        else:
            queue.extend(_blocks(node))


def _segment(lines: list[bytes], node) -> str:
    """A definition's source; columns are bytes."""
    part = lines[node.lineno - 1 : node.end_lineno]
    part[-1] = part[-1][: node.end_col_offset]
    part[0] = part[0][node.col_offset :]
    return b"\n".join(part).decode("utf-8", "replace")


def _function_facts(fn, classes, row):
    cls = ".".join(classes) or None
    owner = ".".join((*classes, fn.name))
    row("func", owner=owner, cls=cls)
    types, own = _locals(fn), _parameters(fn)

    def use(kind, expr, n):
        path = _path(expr)
        if path is None or kind == "ref" and len(path) == 1 and (path[0] in own or path[0] in types):
            return
        q, name = types.get(path[0]) or (None, None)
        row(kind, owner=owner, cls=cls, ord=n, path=path, flag=path[0] in types, qualifier=q, name=name)

    n = 0
    for node in ast.walk(fn):
        if isinstance(node, ast.Call):
            n += 1
            use("call", node.func, n)
            for arg in (*node.args, *(k.value for k in node.keywords)):
                if isinstance(arg, ast.Name | ast.Attribute):
                    n += 1
                    use("ref", arg, n)
    for i, d in enumerate(fn.decorator_list):
        path = _path(d.func if isinstance(d, ast.Call) else d)
        if path and len(path) <= 2:
            row("deco", owner=owner, cls=cls, ord=i, path=path)


def facts(file: str, content: bytes) -> list[tuple]:
    """The rows of one file."""
    rows = []

    def row(kind, **have):
        rows.append(tuple({"kind": kind, "file": file, **have}.get(c) for c in COLUMNS))

    source = (content or b"").decode("utf-8", "ignore")
    if source.encode() != (content or b""):
        row("encoding")
    source = source.removeprefix("﻿")
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        row("broken", name=f"{type(e).__name__}: {e}"[:200])
        return rows
    plain = "\r" not in source and "\f" not in source
    lines = source.encode().split(b"\n")
    last = {}
    for classes, fn in _definitions(tree.body):
        text = _segment(lines[:], fn) if plain else ast.get_source_segment(source, fn)
        if text is not None:  # the last definition of a name counts, at the first one's place
            last[".".join((*classes, fn.name))] = (fn, text)
    for name, (fn, text) in last.items():
        row("symbol", name=name, lineno=fn.lineno, end=fn.end_lineno, code=text, doc=(ast.get_docstring(fn) or "").split("\n")[0] or None)
    if head := ast.get_docstring(tree):
        row("doc", code=head.split("\n")[0][:60])
    for i, (kind, module, name, level, local) in enumerate(_imports(tree)):
        row("import", cls=kind, qualifier=module, name=name, level=level, local=local, ord=i)
    variables = {}
    for node in tree.body:
        if isinstance(node, ast.ClassDef):
            row("class", name=node.name)
            for i, b in enumerate(node.bases):
                if ref := _type_ref(b):
                    row("base", owner=node.name, qualifier=ref[0], name=ref[1], ord=i)
            for attr, (q, name) in _attributes(node).items():
                row("attr", owner=f"{node.name}.{attr}", qualifier=q, name=name)
        elif isinstance(node, _DEF):
            if ref := _returned(node):
                variables["factory", node.name] = ref
        elif isinstance(node, ast.Assign | ast.AnnAssign) and isinstance(node.value, ast.Call) and (ref := _type_ref(node.value.func, deep=False)):
            for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if isinstance(t, ast.Name):
                    variables["var", t.id] = ref
    for (kind, owner), (q, name) in variables.items():
        row(kind, owner=owner, qualifier=q, name=name)
    for classes, fn in _definitions(tree.body, everywhere=False):
        _function_facts(fn, classes, row)
    return rows


def _of_file(file: str, content: bytes) -> list[tuple]:
    if file.endswith(script_facts.EXTENSIONS):
        return script_facts.facts(file, content, COLUMNS)
    if file.rsplit("/", 1)[-1] in script_facts.CONFIGS:
        return script_facts.config_facts(file, content, COLUMNS)
    return facts(file, content)


def fact_batches(batches):
    """For mapInArrow over files(rel_file, content): facts by what a file's name ends with."""
    for b in batches:
        rows = []
        for file, content in zip(b.column("rel_file").to_pylist(), b.column("content").to_pylist(), strict=True):
            rows.extend(_of_file(file, content))
            if len(rows) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], names=list(COLUMNS))
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], names=list(COLUMNS))
