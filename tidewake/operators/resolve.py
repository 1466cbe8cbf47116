"""Names to definitions: imports, types and calls of facts, resolved by joins.

Files are known by paths like ``./pkg/mod.py``. Every step is an equi-join of a fact table
with a table of definitions; the two that chase chains (factories, base classes) loop over
what is still open, and each round is written to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions.python_facts import SCHEMA, fact_batches
from tidewake.operators import edges as E
from tidewake.runtime import arrow, cut

#: Rounds of a chain of factories at most; a chain that is still open then is a cycle.
MOST_CHAIN = 32


def extract_facts(files: DataFrame) -> DataFrame:
    """Facts of files(rel_file, content)."""
    return arrow(files.select("rel_file", "content"), fact_batches, SCHEMA)


def symbols(facts: DataFrame) -> DataFrame:
    """(id, file, name, lineno, end, code, doc), one row an id."""
    s = facts.where("kind = 'symbol'").select(F.concat_ws(":", "file", "name").alias("id"), "file", "name", "lineno", "end", "code", "doc")
    return s.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("lineno")))).where("rn = 1").drop("rn")


# Imports

def _modules(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, target) of modules, x.py before x/__init__.py, and the folders above them."""
    bare = files.select(F.col("rel_file").alias("target"), F.regexp_replace("rel_file", r"^\./", "").alias("f")).where(F.col("f").endswith(".py"))
    own = bare.select(F.regexp_replace("f", r"\.py$", "").alias("path"), "target", F.lit(0).alias("o"))
    package = bare.where(F.col("f").rlike(r"(^|/)__init__\.py$")).select(F.regexp_replace("f", r"/?__init__\.py$", "").alias("path"), "target", F.lit(1).alias("o"))
    modules = own.unionByName(package).groupBy("path").agg(F.min_by("target", "o").alias("target"))
    parts = F.split("f", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.when(i < F.size(parts), F.array_join(F.slice(parts, 1, i), "/")))
    folders = bare.select(F.explode(above).alias("path")).where("path is not null").distinct()
    return modules, folders


def _folder(file):
    return F.regexp_replace(F.regexp_replace(file, r"^\./", ""), r"/?[^/]*$", "")


def _joined(a, b):
    return F.when(a == "", b).when(b == "", a).otherwise(F.concat(a, F.lit("/"), b))


def _upward(folder, steps):
    parts = F.split(folder, "/")
    return F.when(folder == "", "").otherwise(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - steps, F.lit(0))), "/"))


def import_map(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(file, local, target): what each imported name of a file stands for, as a file; the last binding counts.

    Absolute modules are sought below the root, then below src, where a folder alone ends
    the search; a name imported from a package is its submodule, or what the package's
    __init__ imports under it (one level), or the package.
    """
    modules, folders = (cut(x) for x in _modules(files))
    i = facts.where("kind = 'import'").select("file", F.col("cls").alias("how"), "qualifier", "name", "level", "local", "ord", F.regexp_replace("qualifier", r"\.", "/").alias("rel"))
    names = i.where("level = 0").select("rel").distinct()

    def look(df, path, out):
        m = modules.select(F.col("path").alias("tw_path"), F.col("target").alias(out))
        return df.withColumn("tw_key", path).join(m, F.col("tw_key") == F.col("tw_path"), "left").drop("tw_key", "tw_path")

    def exists(df, path, out):
        m = folders.select(F.col("path").alias("tw_path"), F.lit(True).alias(out))
        return df.withColumn("tw_key", path).join(m, F.col("tw_key") == F.col("tw_path"), "left").drop("tw_key", "tw_path")

    below = F.concat(F.lit("src/"), "rel")
    n = exists(look(exists(look(names, F.col("rel"), "t0"), F.col("rel"), "d0"), below, "t1"), below, "d1")
    at_root = F.col("t0").isNotNull() | F.col("d0").isNotNull()
    in_src = ~at_root & (F.col("t1").isNotNull() | F.col("d1").isNotNull())
    n = cut(n.select(F.col("rel").alias("tw_rel"), F.when(in_src, below).otherwise(F.col("rel")).alias("abs_path"), F.when(at_root, F.col("t0")).when(in_src, F.col("t1")).alias("abs_target")))
    i = i.join(n, (F.col("level") == 0) & (F.col("rel") == F.col("tw_rel")), "left").drop("tw_rel")
    i = i.withColumn("path", F.when(F.col("level") == 0, F.col("abs_path")).otherwise(_joined(_upward(_folder("file"), F.col("level") - 1), F.col("rel"))))
    i = look(look(i, F.when(F.col("how") == "from", _joined(F.col("path"), F.col("name"))), "sub"), F.when(F.col("level") > 0, F.col("path")), "near")
    i = look(i, F.when((F.col("how") == "plain") & F.col("abs_target").isNull(), _joined(_folder("file"), F.col("rel"))), "beside")
    i = cut(i.withColumn("module", F.coalesce("abs_target", "near")).withColumn("direct", F.coalesce("sub", F.coalesce("abs_target", "near"))))
    passed_on = i.where("how = 'from' and direct is not null and direct <> file").groupBy(F.col("file").alias("tw_init"), F.col("local").alias("tw_name")).agg(F.min_by("direct", "ord").alias("real"))
    i = i.join(passed_on, (F.col("module") == F.col("tw_init")) & (F.col("name") == F.col("tw_name")) & F.col("module").endswith("/__init__.py"), "left")
    target = F.when(F.col("how") == "from", F.coalesce("sub", "real", "module")).otherwise(F.coalesce("abs_target", "beside"))
    return cut(i.withColumn("target", target).where("target is not null").groupBy("file", "local").agg(F.max_by("target", "ord").alias("target")))


# Types

class Types:
    """Classes of a repository, and what a name means as one."""

    def __init__(self, facts: DataFrame, imports: DataFrame):
        self.imports = imports
        self.classes = cut(facts.where("kind = 'class'").select("file", "name").distinct())
        self.single = self.classes.groupBy("file").agg(F.count("*").alias("k"), F.min("name").alias("only")).where("k = 1").select(F.col("file").alias("tw_file"), "only")
        self.factories = cut(facts.where("kind = 'factory'").select(F.col("file").alias("tw_file"), F.col("owner").alias("tw_fn"), F.col("qualifier").alias("fq"), F.col("name").alias("fn")))

    def step(self, refs: DataFrame) -> DataFrame:
        """refs(file, q, n) with cls, the class that they name, or the type next_(file, q, n) of the factory that they call."""
        im = self.imports.select(F.col("file").alias("tw_file"), F.col("local").alias("tw_local"), "target")
        r = refs.join(im, (F.col("file") == F.col("tw_file")) & (F.coalesce("q", "n") == F.col("tw_local")), "left").drop("tw_file", "tw_local")
        c = self.classes.select(F.col("file").alias("tw_file"), F.col("name").alias("tw_name"), F.concat_ws(":", "file", "name").alias("tw_id"))
        has = lambda df, where, out: df.join(c.withColumnRenamed("tw_id", out), (where == F.col("tw_file")) & (F.col("n") == F.col("tw_name")), "left").drop("tw_file", "tw_name")
        r = has(has(r, F.when(F.col("q").isNull(), F.col("file")), "own"), F.col("target"), "there")
        inits = r.where(F.col("target").endswith("/__init__.py") & F.col("there").isNull()).select("target", "n").distinct()
        inside = inits.join(c, F.col("n") == F.col("tw_name")).where(F.col("tw_file").startswith(F.regexp_replace("target", r"__init__\.py$", "")))
        inside = inside.groupBy(F.col("target").alias("tw_target"), F.col("n").alias("tw_n")).agg(F.min("tw_id").alias("inside"))
        r = r.join(inside, (F.col("target") == F.col("tw_target")) & (F.col("n") == F.col("tw_n")), "left").drop("tw_target", "tw_n")
        known = self.classes.select(F.col("name").alias("tw_name")).distinct().withColumn("known", F.lit(True))
        r = r.join(known, F.col("n") == F.col("tw_name"), "left").drop("tw_name").join(self.single, F.col("target") == F.col("tw_file"), "left").drop("tw_file")
        alone = F.when(F.col("q").isNull() & F.col("known").isNull() & F.col("only").isNotNull(), F.concat_ws(":", "target", "only"))
        r = r.withColumn("cls", F.coalesce("own", "there", "inside", alone)).withColumn("at", F.coalesce("target", F.when(F.col("q").isNull(), F.col("file"))))
        r = r.join(self.factories, (F.col("at") == F.col("tw_file")) & (F.col("n") == F.col("tw_fn")), "left")
        open_ = F.col("cls").isNull() & F.col("fn").isNotNull()
        return r.select("file", "q", "n", "cls", F.when(open_, F.struct(F.col("at").alias("file"), F.col("fq").alias("q"), F.col("fn").alias("n"))).alias("next"))

    def resolve(self, refs: DataFrame, chase: bool = True) -> DataFrame:
        """(file, q, n, cls) of the distinct refs(file, q, n) that name a class; factories are chased on request."""
        first = cut(self.step(refs.select("file", "q", "n").distinct()))
        done = first.where("cls is not null").select("file", "q", "n", "cls")
        if not chase:
            return done
        waiting = first.where("next is not null").select("file", "q", "n", F.col("next.file").alias("f2"), F.col("next.q").alias("q2"), F.col("next.n").alias("n2"))
        for _ in range(MOST_CHAIN):
            if waiting.isEmpty():
                break
            s = self.step(waiting.select(F.col("f2").alias("file"), F.col("q2").alias("q"), F.col("n2").alias("n")).distinct())
            s = s.select(F.col("file").alias("tw_f"), F.col("q").alias("tw_q"), F.col("n").alias("tw_n"), "cls", "next")
            w = cut(waiting.join(s, F.col("f2").eqNullSafe(F.col("tw_f")) & F.col("q2").eqNullSafe(F.col("tw_q")) & F.col("n2").eqNullSafe(F.col("tw_n"))))
            done = done.unionByName(w.where("cls is not null").select("file", "q", "n", "cls"))
            waiting = w.where("next is not null").select("file", "q", "n", F.col("next.file").alias("f2"), F.col("next.q").alias("q2"), F.col("next.n").alias("n2"))
        return done


def _typed(facts: DataFrame, kind: str, types: Types) -> DataFrame:
    """(file, owner, ord, cls) of facts that have a type, resolved."""
    f = facts.where(F.col("kind") == kind).select("file", "owner", "ord", F.col("qualifier").alias("q"), F.col("name").alias("n"))
    return f.join(types.resolve(f).select(F.col("file").alias("tw_f"), F.col("q").alias("tw_q"), F.col("n").alias("tw_n"), "cls"), (F.col("file") == F.col("tw_f")) & F.col("q").eqNullSafe(F.col("tw_q")) & (F.col("n") == F.col("tw_n"))).select("file", "owner", "ord", "cls")


def attribute_owners(facts: DataFrame, types: Types) -> DataFrame:
    """(key, cls): the class of ``file:Class.attr`` and of a module's variable ``file:name``."""
    both = _typed(facts, "var", types).unionByName(_typed(facts, "attr", types))
    return both.groupBy(F.concat_ws(":", "file", "owner").alias("key")).agg(F.max("cls").alias("cls"))


def ancestors(facts: DataFrame, types: Types) -> DataFrame:
    """(cls, ancestor, path): all base classes by the order in which a search, depth first, meets them."""
    f = facts.where("kind = 'base'").select("file", "owner", "ord", F.col("qualifier").alias("q"), F.col("name").alias("n"))
    r = types.resolve(f, chase=False).select(F.col("file").alias("tw_f"), F.col("q").alias("tw_q"), F.col("n").alias("tw_n"), F.col("cls").alias("parent"))
    b = f.join(r, (F.col("file") == F.col("tw_f")) & F.col("q").eqNullSafe(F.col("tw_q")) & (F.col("n") == F.col("tw_n"))).select(F.concat_ws(":", "file", "owner").alias("child"), "parent", "ord")
    b = cut(b.where("child <> parent").groupBy("child", "parent").agg(F.min("ord").alias("ord")))
    new = b.select(F.col("child").alias("cls"), F.col("parent").alias("ancestor"), F.array("ord").alias("path"))
    all_ = new
    while True:
        more = new.join(b, new["ancestor"] == b["child"]).where("cls <> parent").groupBy("cls", F.col("parent").alias("ancestor")).agg(F.min(F.concat("path", F.array("ord"))).alias("path"))
        old = all_.groupBy("cls", "ancestor").agg(F.min("path").alias("best"))
        new = cut(more.join(old, ["cls", "ancestor"], "left").where("best is null or path < best").select("cls", "ancestor", "path"))
        if new.isEmpty():
            return all_.groupBy("cls", "ancestor").agg(F.min("path").alias("path"))
        all_ = cut(all_.unionByName(new).groupBy("cls", "ancestor").agg(F.min("path").alias("path")))


# Calls

def _named(df: DataFrame, file, name, ids: DataFrame, imports: DataFrame, out: str) -> DataFrame:
    """df with the id of a function of the file by that name, else of the imported file."""
    own = ids.select(F.col("file").alias("tw_f"), F.col("name").alias("tw_n"), F.col("id").alias("tw_own"))
    df = df.withColumn("tw_file", file).withColumn("tw_name", name).join(own, (F.col("tw_file") == F.col("tw_f")) & (F.col("tw_name") == F.col("tw_n")), "left").drop("tw_f", "tw_n")
    im = imports.select(F.col("file").alias("tw_f"), F.col("local").alias("tw_l"), F.col("target").alias("tw_t"))
    df = df.join(im, (F.col("tw_file") == F.col("tw_f")) & (F.col("tw_name") == F.col("tw_l")), "left").drop("tw_f", "tw_l")
    there = ids.select(F.col("file").alias("tw_f"), F.col("name").alias("tw_n"), F.col("id").alias("tw_there"))
    df = df.join(there, (F.col("tw_t") == F.col("tw_f")) & (F.col("tw_name") == F.col("tw_n")), "left")
    return df.withColumn(out, F.coalesce("tw_own", "tw_there")).drop("tw_file", "tw_name", "tw_own", "tw_t", "tw_f", "tw_n", "tw_there")


def call_edges(facts: DataFrame, ids: DataFrame, imports: DataFrame, types: Types) -> DataFrame:
    """(src, dst): functions that a function calls, or passes as arguments."""
    f = facts.where("kind in ('call', 'ref')").select(F.concat_ws(":", "file", "owner").alias("src"), "file", "cls", "flag", F.col("qualifier").alias("q"), F.col("name").alias("n"), "path").distinct()
    plain = _named(f.where("size(path) = 1"), F.col("file"), F.col("path")[0], ids, imports, "dst").select("src", "dst")
    owners = cut(attribute_owners(facts, types))
    c = f.where("size(path) > 1").withColumn("root", F.col("path")[0]).withColumn("method", F.element_at("path", -1))
    local = types.resolve(c.where("flag").select("file", "q", "n")).select(F.col("file").alias("tw_f"), F.col("q").alias("tw_q"), F.col("n").alias("tw_n"), F.col("cls").alias("local_cls"))
    c = c.join(local, F.col("flag") & (F.col("file") == F.col("tw_f")) & F.col("q").eqNullSafe(F.col("tw_q")) & (F.col("n") == F.col("tw_n")), "left").drop("tw_f", "tw_q", "tw_n")
    o = owners.select(F.col("key").alias("tw_key"), F.col("cls").alias("tw_cls"))
    me = (F.col("root") == "self") & F.col("cls").isNotNull()
    c = c.join(o, F.concat_ws(":", "file", "root") == F.col("tw_key"), "left").withColumn("owner", F.when(me, F.concat_ws(":", "file", "cls")).when(F.col("flag"), F.col("local_cls")).otherwise(F.col("tw_cls"))).drop("tw_key", "tw_cls")
    c = cut(c.select("src", "file", "path", "method", "owner"))
    longest = c.agg(F.max(F.size("path"))).first()[0] or 0
    for i in range(2, longest):  # a step along a.b.c
        c = c.join(o, (F.size("path") > i) & (F.concat_ws(".", "owner", F.try_element_at("path", F.lit(i))) == F.col("tw_key")) & F.col("owner").isNotNull(), "left")
        c = c.withColumn("owner", F.when(F.size("path") > i, F.col("tw_cls")).otherwise(F.col("owner"))).drop("tw_key", "tw_cls")
    c = cut(c)
    by_id = ids.select(F.col("id").alias("dst"))
    wanted = c.where("owner is not null").select("owner", "method").distinct().withColumn("here", F.concat_ws(".", "owner", "method"))
    direct = wanted.join(by_id, wanted["here"] == by_id["dst"], "left")
    up = ancestors(facts, types).select(F.col("cls").alias("tw_cls"), "ancestor", F.col("path").alias("tw_path"))
    climb = direct.where("dst is null").join(up, F.col("owner") == F.col("tw_cls")).select("owner", "method", "tw_path", F.concat_ws(".", "ancestor", "method").alias("at"))
    inherited = climb.join(by_id, climb["at"] == by_id["dst"]).groupBy("owner", "method").agg(F.min_by("dst", "tw_path").alias("dst"))
    methods = direct.where("dst is not null").select("owner", "method", "dst").unionByName(inherited)
    owned = c.where("owner is not null").join(methods, ["owner", "method"]).select("src", "dst")
    dotted = c.where("owner is null").select("src", "file", "method", F.array_join(F.slice("path", F.lit(1), F.size("path") - 1), ".").alias("module"))
    im = imports.select(F.col("file").alias("tw_f"), F.col("local").alias("module"), "target")
    m = dotted.join(im, "module").where("file = tw_f").select("src", "target", "method")
    there = ids.select(F.col("file").alias("target"), F.col("name").alias("method"), F.col("id").alias("dst"))
    m = m.join(there, ["target", "method"], "left")
    onward = m.where(F.col("dst").isNull() & F.col("target").endswith("/__init__.py")).drop("dst")
    again = imports.select(F.col("file").alias("target"), F.col("local").alias("method"), F.col("target").alias("real"))
    onward = onward.join(again, ["target", "method"]).join(there.select(F.col("target").alias("real"), "method", "dst"), ["real", "method"])
    all_ = plain.unionByName(owned).unionByName(m.select("src", "dst")).unionByName(onward.select("src", "dst"))
    return all_.where("dst is not null and src <> dst").distinct()


def repository_edges(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, kind): the dependency graph of a repository, an edge with its first kind."""
    facts = cut(facts)
    ids = cut(symbols(facts).select("id", "file", "name", "lineno"))
    imports = import_map(facts, files)
    types = Types(facts, imports)
    calls = cut(call_edges(facts, ids, imports, types))
    methods = ids.where(F.instr("name", ".") > 0).select(F.concat_ws(":", "file", F.substring_index("name", ".", 1)).alias("cls"), F.expr("substring(name, instr(name, '.') + 1)").alias("method"), "id")
    bases = _typed(facts, "base", types).select(F.concat_ws(":", "file", "owner").alias("child"), F.col("cls").alias("parent")).distinct()
    bases = cut(bases)
    overrides = cut(E.override_edges(methods, bases))
    family = methods.join(bases, methods["cls"] == bases["child"]).select(F.col("parent").alias("base"), "method", "id")
    deco = facts.where("kind = 'deco'").select(F.concat_ws(":", "file", "owner").alias("src"), "file", "path", "ord")
    named = _named(deco.where("size(path) = 1"), F.col("file"), F.col("path")[0], ids, imports, "dst").select("src", "dst", "ord")
    im = imports.select(F.col("file").alias("tw_f"), F.col("local").alias("tw_l"), F.col("target").alias("tw_t"))
    there = ids.select(F.col("file").alias("tw_t"), F.col("name").alias("tw_n"), F.col("id").alias("dst"))
    dotted = deco.where("size(path) = 2").join(im, (F.col("file") == F.col("tw_f")) & (F.col("path")[0] == F.col("tw_l"))).withColumn("tw_n", F.col("path")[1]).join(there, ["tw_t", "tw_n"]).select("src", "dst", "ord")
    deco = named.unionByName(dotted).where("dst is not null").join(ids.select(F.col("id").alias("src")), "src", "left_semi")
    before = calls.unionByName(overrides)
    deco = deco.groupBy("src", "dst").agg(F.min("ord").alias("ord")).join(before, ["src", "dst"], "left_anti")
    placed = ids.withColumn("directory", F.regexp_replace("file", r"/[^/]*$", ""))
    kinds = [
        ("call", calls), ("override", overrides), ("decorator", E.decorator_edges(deco)), ("import", E.shared_import_edges(ids, imports.select("file", "target"))),
        ("directory", E.same_directory_edges(placed)), ("window", E.window_edges(ids)), ("child", E.parent_child_edges(overrides)), ("sibling", E.sibling_override_edges(family)),
    ]
    out = None
    for i, (kind, e) in enumerate(kinds):
        e = e.select("src", "dst", F.lit(i).alias("o"), F.lit(kind).alias("kind"))
        out = e if out is None else out.unionByName(e)
    return out.groupBy("src", "dst").agg(F.min_by("kind", "o").alias("kind"))
