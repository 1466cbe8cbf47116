"""A repository from files and git to packages, incremental updates and the command line."""

import json
import subprocess
import textwrap

import pytest
from pyspark.sql import functions as F

from tidewake import api, cli
from tidewake.operators import index as I
from tidewake.operators import render
from tidewake.sources import files as S
from tidewake.sources import git, stores

SOURCES = {
    "shop/__init__.py": "",
    "shop/mail.py": '"""Mail rules."""\n\ndef good_mail(mail):\n    return "@" in mail\n\n\ndef send(mail, text):\n    if good_mail(mail):\n        return text\n',
    "shop/desk.py": "from .mail import good_mail, send\n\ndef welcome(mail):\n    return send(mail, 'hello')\n\n\ndef check(mail):\n    return good_mail(mail)\n",
    "tools/run.py": "from shop.desk import welcome\n\ndef main(xs):\n    return [welcome(x) for x in xs]\n",
    "broken.py": "def f(:\n",
}


def put(root, sources):
    for name, source in sources.items():
        f = root / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(textwrap.dedent(source))


def commit(root, message="change"):
    for args in (["add", "-A"], ["-c", "user.name=a", "-c", "user.email=a@b", "commit", "-qm", message]):
        subprocess.run(["git", "-C", str(root), *args], check=True)


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    subprocess.run(["git", "-C", str(root), "init", "-q"], check=True)
    put(root, SOURCES | {".gitignore": "out/\n", "out/x.py": "def no():\n    pass\n", "node_modules/y.py": "def no():\n    pass\n"})
    commit(root)
    return root


def edges(ix):
    return {(r.src, r.dst, r.kind) for r in ix.edges.collect()}


def test_files_symbols_and_broken(spark, repo):
    names = {r.rel_file for r in S.discover(spark, str(repo)).collect()}
    assert names == {f"./{x}" for x in SOURCES}
    ix = I.index_repository(spark, str(repo))
    assert {r.id for r in ix.symbols.collect()} == {"./shop/mail.py:good_mail", "./shop/mail.py:send", "./shop/desk.py:welcome", "./shop/desk.py:check", "./tools/run.py:main"}
    assert [r.file for r in ix.broken.collect()] == ["./broken.py"] and ix.docs.first().doc == "Mail rules."
    assert ("./tools/run.py:main", "./shop/desk.py:welcome", "call") in edges(ix)
    plain = {r.rel_file for r in S.discover(spark, str(repo / "shop")).collect()}
    assert plain == {"./__init__.py", "./mail.py", "./desk.py"}


def test_update_equals_rebuild_and_cache_parses_once(spark, repo, tmp_path):
    ix = I.index_repository(spark, str(repo))
    put(repo, {"shop/desk.py": SOURCES["shop/desk.py"].replace("return good_mail(mail)", "return welcome(mail)"), "shop/more.py": "from .mail import send\n\ndef more():\n    return send(1, 2)\n"})
    (repo / "tools/run.py").unlink()
    new = I.update_index(ix, ["shop/desk.py", str(repo / "shop/more.py"), "./tools/run.py"])
    assert edges(new) == edges(I.index_repository(spark, str(repo)))
    assert new.symbols.count() == 5
    c = stores.FactCache(str(tmp_path / "cache"))
    files = S.discover(spark, str(repo))
    first, n = c.facts(files)
    known = first.where("kind = 'symbol'").count()
    assert n == files.count() and c.facts(files)[1] == 0
    put(repo, {"shop/mail.py": SOURCES["shop/mail.py"] + "\ndef x():\n    pass\n"})
    again, n = c.facts(S.discover(spark, str(repo)))
    assert n == 1 and again.where("kind = 'symbol'").count() == known + 1
    cached = I.index_repository(spark, str(repo), str(tmp_path / "cache"))
    assert edges(cached) == edges(I.index_repository(spark, str(repo), str(tmp_path / "cache"))) == edges(I.index_repository(spark, str(repo)))
    for i in range(7):
        c.put_graph(cached.edges.limit(1), f"state{i}", 5)
    assert sum(c.get_graph(spark, f"state{i}") is not None for i in range(7)) == 5
    c.forget(spark, "./shop/mail.py")
    assert c.facts(S.discover(spark, str(repo)))[1] == 1


def test_state_hash_follows_content_only(spark, repo):
    f = S.discover(spark, str(repo))
    state = lambda x: S.state_hash(x).first().state
    assert state(f) == state(f.orderBy(F.desc("rel_file")).repartition(3))
    assert state(f) != state(f.where("rel_file <> './broken.py'"))


def test_changes_since_a_commit(spark, repo):
    put(repo, {"shop/mail.py": SOURCES["shop/mail.py"].replace("return text", "return text + '!'"), "shop/desk.py": SOURCES["shop/desk.py"].replace("def check", "def proof")})
    ix = I.index_repository(spark, str(repo))
    got = {r.id for r in I.find_changed(ix, "HEAD").collect()}
    assert got == {"./shop/mail.py:send", "./shop/desk.py:proof", "./shop/desk.py:check"}
    put(repo, {"shop/desk.py": "def welcome(:\n"})
    ix = I.update_index(ix, ["shop/desk.py"])
    assert {r.id for r in I.find_changed(ix, "HEAD").collect()} == {"./shop/mail.py:send", "./shop/desk.py:welcome", "./shop/desk.py:check"}
    with pytest.raises(ValueError, match="not a ref"):
        git.changed_files(spark, str(repo), "--output=x")


def test_history_blobs_and_hunks(spark, repo):
    put(repo, {"shop/mail.py": SOURCES["shop/mail.py"] + "# end\n", "shop/desk.py": SOURCES["shop/desk.py"] + "# end\n"})
    commit(repo, "two files")
    log = git.history(spark, str(repo))
    rows = log.orderBy(F.desc("ord"), "file").collect()
    assert [(r.subject, r.file) for r in rows][:2] == [("two files", "./shop/desk.py"), ("two files", "./shop/mail.py")] and len({r.commit for r in rows}) == 2
    newest = log.where("subject = 'two files'")
    h = {(r.file, r.hstart, r.hend) for r in git.history_hunks(newest, str(repo)).collect()}
    assert h == {("./shop/mail.py", 10, 10), ("./shop/desk.py", 9, 9)}
    b = {r.rel_file: r.content for r in git.blobs(newest.select(F.lit("HEAD~1").alias("commit"), F.col("file").alias("rel_file")).union(spark.createDataFrame([("HEAD", "./no.py")], "commit string, rel_file string")), str(repo)).collect()}
    assert bytes(b["./shop/mail.py"]).decode() == SOURCES["shop/mail.py"] and b["./no.py"] is None
    assert git.history(spark, str(repo.parent)).count() == 0 and not git.is_repository(str(repo.parent / "none"))
    patch = spark.createDataFrame([("./a.py", "@@ -1,2 +3,4 @@ x\n+a\n@@ -9 +12 @@\n@@ -5,3 +20,0 @@\n")], "rel_file string, patch string")
    assert {(r.hstart, r.hend) for r in git.hunks(patch).collect()} == {(3, 6), (12, 12), (20, 20)}


def test_packages_fit_their_budget(spark, repo):
    body = "\n".join(f"    x{i} = mail + '{i}'" for i in range(18))
    put(repo, {f"extra/m{i}.py": f"from shop.mail import send\n\ndef job{i}(mail):\n{body}\n    return send(mail, x1)\n" for i in range(12)})
    ix = I.index_repository(spark, str(repo))
    changed = spark.createDataFrame([(0, "./shop/mail.py:send"), (1, "./shop/desk.py:check")], "query_id int, id string")
    scores = I.impact(ix, changed)
    for budget in (300, 800, 2000, None):
        for r in I.compile_context(ix, scores, changed, budget).collect():
            want = {0: "./shop/mail.py:send", 1: "./shop/desk.py:check"}[r.query_id]
            assert want in r.ids and not set(r.ids) & set(r.dropped)
            assert r.tokens == max(1, len(r.text) // 4)
            assert budget is None or r.tokens <= budget or r.ids == [want]
            assert "=== CHANGED SYMBOLS ===" in r.text and "FILES THAT DON'T PARSE (1)" in r.text
            assert f"Output tokens (full)  : {r.tokens:,}" in r.text
    whole = I.compile_context(ix, scores, changed, None, None).where("query_id = 0").first()
    assert "CALLERS: ./extra/m0.py:job0" in whole.text and "... +" in whole.text and not whole.dropped
    with pytest.raises(ValueError, match="cutoff"):
        I.compile_context(ix, scores, changed, cutoff="no")


def test_proofs_and_trees(spark):
    s = spark.createDataFrame([("./a.py:f", "def f():\n    x = 1\n    return  g(x)", 10), ("./a.py:g", "def g(x):\n    pass", 20)], "id string, code string, lineno int")
    e = spark.createDataFrame([("./a.py:f", "./a.py:g"), ("./a.py:g", "./a.py:f"), ("./no.py:h", "./a.py:f")], "src string, dst string")
    p = {(r.src, r.dst): (r.line, r.text) for r in render.proof_lines(e, s).collect()}
    assert p == {("./a.py:f", "./a.py:g"): (12, "return  g(x)"), ("./a.py:g", "./a.py:f"): (None, None), ("./no.py:h", "./a.py:f"): (None, None)}
    hops = spark.createDataFrame([(0, "a", 0), (0, "b", 1), (0, "c", 1), (0, "d", 2)], "query_id int, id string, hops int")
    parents = spark.createDataFrame([(0, "b", "a"), (0, "c", "a"), (0, "d", "c"), (0, "d", "b"), (0, "a", "d")], "query_id int, id string, parent string")
    assert [r.line for r in render.blast_tree(hops, parents).orderBy("pos").collect()] == ["a", "└─ b", "   └─ d", "└─ c"]


def test_cases_and_command_line(spark, repo, tmp_path, capsys):
    good = {"version": 1, "defaults": {"budget": 4000, "min_recall": 0.5}, "cases": [{"name": "a", "changed": ["./shop/mail.py:send"], "must_include": ["./shop/desk.py:welcome", "./gone.py:x"]}, {"name": "b", "changed": ["./shop/mail.py:send"], "must_include": ["./shop/desk.py:welcome"], "must_exclude": ["./tools/run.py:main"], "top_k": 0}]}
    path = tmp_path / "cases.json"
    path.write_text(json.dumps(good))
    c = {r.name: r for r in stores.load_cases(spark, str(path)).collect()}
    assert c["a"].budget == 4000 and c["a"].depth == 2 and c["b"].top_k == 0 and c["b"].min_recall == 0.5 and c["a"].must_exclude == []
    stores.save_cases(stores.load_cases(spark, str(path)), str(tmp_path / "again.json"))
    assert {r.name for r in stores.load_cases(spark, str(tmp_path / "again.json")).collect()} == {"a", "b"}
    for wrong in ({"name": "x", "changed": [], "must_include": ["a"]}, {"name": "x", "changed": ["a"]}, {"changed": ["a"], "must_include": ["a"]}, {"name": "x", "changed": ["a"], "must_include": ["a"], "min_recall": 2.0}):
        path.write_text(json.dumps({"cases": [wrong]}))
        with pytest.raises(Exception, match="a case has no|min_recall"):
            stores.load_cases(spark, str(path)).collect()
    path.write_text(json.dumps(good))
    assert cli.main(["verify", "--repo", str(repo), "--cases", str(path)]) == 1
    out = capsys.readouterr().out
    assert "PASS  a: recall 0.50, 1 missing" in out and "FAIL  b: recall 1.00" in out
    assert cli.main(["index", "--repo", str(repo)]) == 0 and "symbols 5" in capsys.readouterr().out
    assert cli.main(["blast", "--repo", str(repo), "--changed", "./shop/mail.py:send"]) == 0 and "└─ ./shop/desk.py:welcome" in capsys.readouterr().out
    assert cli.main(["impact", "--repo", str(repo), "--changed", "./shop/mail.py:sned", "--verify"]) == 0 and "./shop/mail.py:send" in capsys.readouterr().err
    put(repo, {"shop/mail.py": SOURCES["shop/mail.py"].replace("return text", "return text + '!'")})
    assert cli.main(["diff", "HEAD", "--repo", str(repo)]) == 0 and capsys.readouterr().out.split() == ["./shop/mail.py:send"]
    assert cli.main(["compile", "--repo", str(repo), "--ref", "HEAD", "--json", "--with-history", "--cutoff", "gap"]) == 0
    assert json.loads(capsys.readouterr().out)["ids"][0] == "./shop/mail.py:send"
    r = api.blast_radius("./shop/mail.py:good_mail", repo=str(repo))
    assert {"./shop/mail.py:send", "./shop/desk.py:check"} <= set(r.callers) and r.total_affected >= 4
    assert api.blast_radius(ref="HEAD", repo=str(repo / "..")).changed == []


def test_states_calibrations_and_sinks(spark, tmp_path):
    s = spark.createDataFrame([("a", "x", "f")], "id string, code string, file string")
    assert stores.load_state(spark, str(tmp_path / "none")).count() == 0
    stores.save_state(s, str(tmp_path / "s"))
    assert stores.load_state(spark, str(tmp_path / "s")).collect() == s.collect()
    assert stores.load_calibration(str(tmp_path / "none.json")) is None
    stores.save_calibration({"n": 1}, str(tmp_path / "c.json"))
    assert stores.load_calibration(str(tmp_path / "c.json")) == {"n": 1}
    (tmp_path / "bad.json").write_text("[1")
    assert stores.load_calibration(str(tmp_path / "bad.json")) is None
    for kind in ("csv", "json", "parquet"):
        stores.write_rows(s, str(tmp_path / kind), kind)
        stores.write_rows(s, str(tmp_path / kind), kind)
        assert (spark.read.option("header", True).format(kind).load(str(tmp_path / kind))).count() == 2


def test_paths(spark):
    p = spark.createDataFrame([("a/node_modules/x.py",), ("a/x.py",), ("build",), ("k.egg-info/x.py",), ("a/x.min.js",), ("a/x.spec.ts",)], "p string")
    assert [r.p for r in p.where(~S.excluded("p")).collect()] == ["a/x.py", "build", "a/x.min.js", "a/x.spec.ts"]
    assert [r.p for r in p.where(S.should_index("p")).collect()] == ["a/node_modules/x.py", "a/x.py", "build", "k.egg-info/x.py"]
    assert S.adapter_for_path("x/y.py") and S.adapter_for_path("x/y.rs") is None
    assert S.indexable_extensions() == (".cjs", ".js", ".jsx", ".mjs", ".py", ".ts", ".tsx")
    q = spark.createDataFrame([("./static/a.py",), ("./static/a.js",), ("./src/OUT/a.ts",), ("./outer/a.tsx",), ("./a.spec.js",), ("./spec.js",)], "p string")
    assert [r.p for r in q.where(S.should_index("p")).collect()] == ["./static/a.py", "./outer/a.tsx", "./spec.js"]
    f = spark.createDataFrame([("./a.py", b"x"), ("./b.py", b"\xff")], "rel_file string, content binary")
    assert [r.rel_file for r in S.encoding_problems(f).collect()] == ["./b.py"]
    assert S.once(spark.createDataFrame([("s", "f", 2), ("s", "f", 1), ("t", "f", 3)], "session string, file string, line int"), "session", "file").count() == 2
