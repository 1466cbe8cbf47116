"""The dependency graph of TypeScript and JavaScript files: facts resolved by joins.

A specifier is sought as a file by the probes of bundlers: as it stands, a script's
TypeScript twin, with each extension, and as a folder's index. Names that aren't relative
go by the nearest tsconfig.json or jsconfig.json (``paths`` in order, then ``baseUrl``).
Files that pass names on are followed for MOST_HOPS steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.functions.script_facts import EXTENSIONS
from tidewake.runtime import cut, small

MOST_HOPS = 3


def _probed(wanted: DataFrame, files: DataFrame, *keys: str) -> DataFrame:
    """(keys, target) of wanted(keys, path, ord) that a file answers; the least ord's first probe counts."""
    path, listed = F.col("path"), [F.lit(x) for x in EXTENSIONS]
    script = path.rlike(r"\.(js|mjs|cjs)$")
    bare = ~F.regexp_extract(path, r"[^/.][^/]*(\.[^./]*)$", 1).isin(*EXTENSIONS)
    root = F.regexp_replace(path, r"\.[^./]*$", "")
    none = F.array().cast("array<string>")
    probes = F.concat(
        F.array(path), F.when(script, F.array(F.concat(root, F.lit(".ts")), F.concat(root, F.lit(".tsx")))).otherwise(none),
        F.when(bare, F.array(*[F.concat(path, x) for x in listed], *[F.concat(path, F.lit("/index"), x) for x in listed])).otherwise(none),
    )
    c = wanted.select(*keys, "ord", F.posexplode(probes).alias("probe", "p")).withColumn("p", F.concat(F.lit("./"), F.regexp_replace("p", r"^\./", "")))
    have = files.select(F.col("rel_file").alias("tw_file"))
    return c.join(have, F.col("p") == F.col("tw_file")).groupBy(*keys).agg(F.min_by("p", F.struct("ord", "probe")).alias("target"))


def specifiers(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(file, spec, target): what each specifier of a file stands for, among files(rel_file)."""
    s = cut(facts.where("kind in ('ts_import', 'ts_export', 'ts_star')").select("file", F.col("qualifier").alias("spec"), "doc").distinct())
    near = s.where("doc is not null").select("file", "spec", F.col("doc").alias("path"), F.lit(0).alias("ord"))
    c = facts.where("kind = 'ts_config'").select(F.regexp_replace("file", r"^\./", "").alias("f"), "qualifier", "name", "ord")
    c = c.withColumn("dir", F.regexp_replace("f", r"/?[^/]*$", ""))
    first = c.groupBy("dir").agg(F.max("f").alias("f"))  # tsconfig before jsconfig
    c = cut(c.join(first, ["dir", "f"]).where("name is not null").select("dir", "qualifier", F.regexp_replace("name", r"^\./", "").alias("name"), "ord"))
    far = s.where("doc is null").select("file", "spec")
    parts = F.split(F.regexp_replace(F.regexp_replace("file", r"^\./", ""), r"/?[^/]*$", ""), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    dirs = far.select("file").distinct().select("file", F.explode(F.array_distinct(above)).alias("dir"))
    of = dirs.join(small(c.select("dir").distinct()), "dir").groupBy("file").agg(F.max_by("dir", F.length("dir")).alias("dir"))
    star = F.col("qualifier").endswith("*")
    head = F.expr("substring(qualifier, 1, length(qualifier) - 1)")
    fits = F.col("qualifier").isNull() | (star & F.col("spec").startswith(head)) | (~star & (F.col("spec") == F.col("qualifier")))
    rest = F.when(star, F.expr("substring(spec, length(qualifier))")).otherwise("")
    path = F.when(F.col("qualifier").isNull(), F.when(F.col("name") == ".", F.col("spec")).otherwise(F.concat_ws("/", "name", "spec"))).otherwise(F.replace("name", F.lit("*"), rest))
    mapped = far.join(of, "file").join(c, "dir").where(fits).select("file", "spec", path.alias("path"), "ord")
    return cut(_probed(near.unionByName(mapped), files, "file", "spec"))


def _definitions(facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(file, name) of classes; (file, name, id) of types, of callables; (file, cls, method)."""
    classes = facts.where("kind = 'ts_class'").select("file", "name").distinct()
    of = facts.where(F.lower("file").rlike(r"\.([tj]sx?|[mc]js)$") & (F.col("kind") == "symbol"))
    types = of.where("flag").select("file", "name", F.concat_ws(":", "file", "name").alias("id")).distinct()
    methods = facts.where("kind = 'ts_method'").select("file", F.col("owner").alias("cls"), F.col("name").alias("method")).distinct()
    made = methods.where("method = 'constructor'").select("file", F.col("cls").alias("name"), F.concat(F.concat_ws(":", "file", "cls"), F.lit(".constructor")).alias("id"))
    both = of.where("not flag").select("file", "name", F.concat_ws(":", "file", "name").alias("id")).withColumn("o", F.lit(0)).unionByName(made.withColumn("o", F.lit(1)))
    callables = both.groupBy("file", "name").agg(F.min_by("id", "o").alias("id")).join(types.select("file", "name"), ["file", "name"], "left_anti")
    return cut(classes), cut(types), cut(callables), cut(methods)


def _passed_on(asked: DataFrame, facts: DataFrame, found: DataFrame, defined: DataFrame) -> DataFrame:
    """(file0, name0, file, name): where the names asked(file0, name0) of files come from, through files that export what others define."""
    spec = found.select(F.col("file").alias("tw_f"), F.col("spec").alias("tw_s"), "target")
    named = facts.where("kind = 'ts_export'").select("file", "qualifier", F.col("local").alias("name"), F.col("name").alias("orig"), "ord")
    named = named.groupBy("file", "name").agg(F.max_by(F.struct("qualifier", "orig"), "ord").alias("x")).select("file", "name", "x.*")  # the last of a name counts
    named = cut(named.join(spec, (F.col("file") == F.col("tw_f")) & (F.col("qualifier") == F.col("tw_s"))).select(F.col("file").alias("tw_file"), F.col("name").alias("tw_name"), "orig", "target"))
    stars = facts.where("kind = 'ts_star'").join(spec, (F.col("file") == F.col("tw_f")) & (F.col("qualifier") == F.col("tw_s"))).select(F.col("file").alias("tw_file"), "ord", "target")
    stars = cut(stars)
    known = defined.select(F.col("file").alias("tw_df"), F.col("name").alias("tw_dn"), F.lit(True).alias("here")).distinct()
    open_ = asked.select("file0", "name0", F.col("file0").alias("file"), F.col("name0").alias("name"), F.array().cast("array<int>").alias("path")).distinct()
    done = None
    for hop in range(MOST_HOPS + 1):
        r = open_.join(known, (F.col("file") == F.col("tw_df")) & (F.col("name") == F.col("tw_dn")), "left").drop("tw_df", "tw_dn")
        if hop == MOST_HOPS:
            more, ended = None, r.where("here")
        else:
            r = cut(r.join(named, (F.col("file") == F.col("tw_file")) & (F.col("name") == F.col("tw_name")), "left").drop("tw_file", "tw_name"))
            ended = r.where("target is null and here")
            by_name = r.where("target is not null").select("file0", "name0", F.col("target").alias("file"), F.col("orig").alias("name"), "path")
            rest = r.where("target is null and here is null").drop("target", "orig")
            by_star = rest.join(stars, F.col("file") == F.col("tw_file")).select("file0", "name0", F.col("target").alias("file"), "name", F.concat("path", F.array("ord")).alias("path"))
            more = cut(by_name.unionByName(by_star))
        ended = ended.select("file0", "name0", "file", "name", "path")
        done = ended if done is None else done.unionByName(ended)
        if more is None or more.isEmpty():
            break
        open_ = more
    first = done.groupBy("file0", "name0").agg(F.min_by(F.struct("file", "name"), "path").alias("x"))
    return cut(first.select("file0", "name0", "x.file", "x.name"))


def import_map(facts: DataFrame, found: DataFrame, defined: DataFrame) -> DataFrame:
    """(file, local, target, exported): exported is ``*`` for all of a file, null for its default."""
    i = facts.where("kind = 'ts_import'").select("file", F.col("qualifier").alias("spec"), "local", "name", "ord").join(found, ["file", "spec"])
    i = cut(i.groupBy("file", "local").agg(F.max_by(F.struct("target", "name"), "ord").alias("x")).select("file", "local", "x.target", "x.name"))
    by_name = i.where("name is not null and name <> '*'")
    real = _passed_on(by_name.select(F.col("target").alias("file0"), F.col("name").alias("name0")), facts, found, defined)
    real = real.select("file0", "name0", F.col("file").alias("to"), F.col("name").alias("as"))
    i = i.join(real, (F.col("target") == F.col("file0")) & (F.col("name") == F.col("name0")), "left")
    return cut(i.select("file", "local", F.coalesce("to", "target").alias("target"), F.coalesce("as", "name").alias("exported")))


def script_edges(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, kind) of facts and the files(rel_file) that they are of; kind is call, type or override."""
    facts = cut(facts)
    found = specifiers(facts, files)
    classes, types, callables, methods = _definitions(facts)
    defined = facts.where("kind in ('symbol', 'ts_class')").select("file", "name").distinct()
    imports = import_map(facts, found, defined)
    im = imports.select(F.col("file").alias("tw_if"), F.col("local").alias("tw_local"), "target", "exported")

    def looked_up(df: DataFrame, name: str, table: DataFrame, out: str) -> DataFrame:
        """df(file, name) with out of table(file, name, out): of the own file, else of what the name is imported as."""
        t = table.select(F.col("file").alias("tw_f"), F.col("name").alias("tw_n"), F.col(out).alias("tw_out"))
        df = df.join(t.withColumnRenamed("tw_out", "tw_own"), (F.col("file") == F.col("tw_f")) & (F.col(name) == F.col("tw_n")), "left").drop("tw_f", "tw_n")
        df = df.join(im, (F.col("file") == F.col("tw_if")) & (F.col(name) == F.col("tw_local")), "left").drop("tw_if", "tw_local")
        there = F.when(F.coalesce(F.col("exported") != "*", F.lit(True)), F.coalesce("exported", name))
        df = df.withColumn("tw_there", there).join(t, (F.col("target") == F.col("tw_f")) & (F.col("tw_there") == F.col("tw_n")), "left")
        return df.withColumn(out, F.coalesce("tw_own", "tw_out")).drop("tw_f", "tw_n", "tw_own", "tw_out", "tw_there", "target", "exported")

    class_ids = cut(classes.withColumn("cid", F.struct(F.col("file").alias("f"), F.col("name").alias("n"))))
    bases = facts.where("kind = 'ts_base'").select("file", F.col("owner").alias("cls"), F.col("name").alias("base"))
    parents = cut(looked_up(bases, "base", class_ids, "cid").where("cid is not null").select("file", "cls", F.col("cid.f").alias("pf"), F.col("cid.n").alias("pc")))

    use = cut(facts.where("kind = 'ts_use'").select("file", F.concat_ws(":", "file", "owner").alias("src"), F.col("cls").alias("how"), "name", F.col("qualifier").alias("type"), F.col("local").alias("recv")))
    plain = looked_up(use.where("how in ('call', 'new', 'arg')"), "name", callables, "id").where("id is not null and not (how = 'arg' and endswith(id, '.constructor'))").select("src", F.col("id").alias("dst"))
    own = use.where("how = 'own'").select("src", F.concat_ws(":", "file", "name").alias("dst"))
    up = use.where("how = 'super'").join(parents.withColumnRenamed("cls", "name"), ["file", "name"])
    up = up.join(callables.select(F.col("file").alias("pf"), F.col("name").alias("pc"), F.col("id").alias("dst")), ["pf", "pc"]).select("src", "dst")

    r = use.where("how = 'recv'").withColumn("row", F.monotonically_increasing_id())
    r = cut(r.join(im, (F.col("file") == F.col("tw_if")) & (F.col("recv") == F.col("tw_local")) & (F.col("exported") == "*"), "left").drop("tw_if", "tw_local"))
    spaces = r.where("target is not null").join(callables.select(F.col("file").alias("target"), "name", F.col("id").alias("dst")), ["target", "name"]).select("src", "dst")
    typed = cut(looked_up(looked_up(r.where("target is null and type is not null").drop("target", "exported"), "type", class_ids, "cid"), "type", types, "id"))
    contracts = typed.where("cid is null and id is not null").select("src", F.col("id").alias("dst"))
    m = methods.select(F.col("file").alias("mf"), F.col("cls").alias("mc"), F.col("method").alias("mm"))
    c = typed.where("cid is not null").select("src", "name", F.col("cid.f").alias("cf"), F.col("cid.n").alias("cc"))
    c = c.join(m, (F.col("cf") == F.col("mf")) & (F.col("cc") == F.col("mc")) & (F.col("name") == F.col("mm")), "left")
    there = c.where("mm is not null").select("src", F.concat(F.concat_ws(":", "cf", "cc"), F.lit("."), F.col("name")).alias("dst"))
    above = c.where("mm is null").drop("mf", "mc", "mm").join(parents, (F.col("cf") == F.col("file")) & (F.col("cc") == F.col("cls")))
    above = above.join(m, (F.col("pf") == F.col("mf")) & (F.col("pc") == F.col("mc")) & (F.col("name") == F.col("mm"))).select("src", F.concat(F.concat_ws(":", "pf", "pc"), F.lit("."), F.col("name")).alias("dst"))
    mentioned = looked_up(looked_up(use.where("how = 'ann'"), "name", class_ids, "cid"), "name", types, "id").where("cid is null and id is not null").select("src", F.col("id").alias("dst"))
    child = parents.join(methods, ["file", "cls"]).join(m, (F.col("pf") == F.col("mf")) & (F.col("pc") == F.col("mc")) & (F.col("method") == F.col("mm")))
    overrides = child.select(F.concat(F.concat_ws(":", "file", "cls"), F.lit("."), F.col("method")).alias("src"), F.concat(F.concat_ws(":", "pf", "pc"), F.lit("."), F.col("method")).alias("dst"))

    out = None
    for o, (kind, e) in enumerate((("call", plain), ("call", own), ("call", up), ("call", spaces), ("call", there), ("call", above), ("type", contracts), ("type", mentioned), ("override", overrides))):
        e = e.select("src", "dst", F.lit(o).alias("o"), F.lit(kind).alias("kind"))
        out = e if out is None else out.unionByName(e)
    return out.where("src <> dst").groupBy("src", "dst").agg(F.min_by("kind", "o").alias("kind"))
