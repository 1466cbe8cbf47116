"""Facts and edges of TypeScript and JavaScript files written here."""

import pytest

from tidewake.functions.python_facts import COLUMNS
from tidewake.functions.script_facts import config_facts, facts
from tidewake.operators import index as I
from tidewake.operators import resolve, script_graph

STORE = {
    "lib/text.ts": """
export function clip(x: string): string { return x.slice(0, 9); }
export const shout = (x: string) => x.toUpperCase();
export function spare(): void {}
""",
    "lib/things/base.ts": """
export class Item {
  constructor(public key: string) {}
  store(): void { check(this.key); }
  label(): string { return this.key; }
}
function check(key: string): void {}
""",
    "lib/things/book.ts": """
import { Item } from './base';
import { clip, shout as cry } from '../text.js';
import * as text from '../text';

export class Book extends Item {
  constructor(key: string, public title: string) { super(key); }
  store(): void { this.tidy(); }
  @logged('x') async tidy(a?: Map<string, number>): Promise<void> { cry(this.title); clip(`a ${text.spare()} }`); }
}

export interface Shelf { width: number; }

export const newBook = (key: string) => new Book(key, 'untitled');
export function each(xs: string[], then: (x: string) => void) {
  xs.forEach(then);
  xs.map(cry);
}
""",
    "lib/index.ts": """
export { Book, newBook as makeBook } from './things/book';
export * from './text';
""",
    "lib/main.ts": """
import { makeBook, clip } from './index';
// clip(0) in a comment, "spare()" in a string
export function main(): void {
  const b = makeBook('1');
  if (b) { clip('5'); }
}
""",
}
TYPED = {
    "tsconfig.json": """{
  // paths of this project
  "compilerOptions": { "baseUrl": "./lib", "paths": { "@data/*": ["data/*"], }, },
}""",
    "lib/data/db.ts": """
export class Rows { read(q: string): void {} }
export class Table extends Rows { close(): void {} }
export interface Log { line(m: string): void; }
export type Found = { n: number };
""",
    "lib/use.ts": """
import { Table, Log, Found } from '@data/db';
import { helper } from 'tools';

export class Desk {
  private cache: Table;
  constructor(private db: Table) {}
  seek(id: string, log: Log): void {
    this.db.read(id);
    this.cache.close();
    log.line(id);
  }
}

export function run(desk: Desk): Found {
  const t = new Table(), s: Table = open();
  t.read('x');
  desk.seek('1', null as any);
  return { n: helper(1) };
}
function open(): Table { return new Table(); }
""",
    "lib/tools.js": "export function helper(n) { return n / 2 / n; }\n",
}


def table(spark, sources):
    return spark.createDataFrame([(f"./{k}", v.encode()) for k, v in sources.items()], "rel_file string, content binary")


def graph(spark, sources):
    f = table(spark, sources)
    short = lambda x: x.removeprefix("./lib/")
    return {(short(r.src), short(r.dst)): r.kind for r in script_graph.script_edges(resolve.extract_facts(f), f).collect()}


def test_edges_of_classes_imports_and_files_that_pass_names_on(spark):
    assert graph(spark, STORE) == {
        ("things/base.ts:Item.store", "things/base.ts:check"): "call",
        ("things/book.ts:Book.constructor", "things/base.ts:Item.constructor"): "call",
        ("things/book.ts:Book.store", "things/book.ts:Book.tidy"): "call",
        ("things/book.ts:Book.store", "things/base.ts:Item.store"): "override",
        ("things/book.ts:Book.tidy", "text.ts:shout"): "call",
        ("things/book.ts:Book.tidy", "text.ts:clip"): "call",
        ("things/book.ts:Book.tidy", "text.ts:spare"): "call",
        ("things/book.ts:newBook", "things/book.ts:Book.constructor"): "call",
        ("things/book.ts:each", "text.ts:shout"): "call",
        ("main.ts:main", "things/book.ts:newBook"): "call",
        ("main.ts:main", "text.ts:clip"): "call",
    } | {("things/book.ts:Book.constructor", "things/base.ts:Item.constructor"): "call"}


def test_edges_by_declared_types_and_config_paths(spark):
    assert graph(spark, TYPED) == {
        ("use.ts:Desk.seek", "data/db.ts:Rows.read"): "call",
        ("use.ts:Desk.seek", "data/db.ts:Table.close"): "call",
        ("use.ts:Desk.seek", "data/db.ts:Log"): "type",
        ("use.ts:run", "data/db.ts:Rows.read"): "call",
        ("use.ts:run", "use.ts:Desk.seek"): "call",
        ("use.ts:run", "use.ts:open"): "call",
        ("use.ts:run", "tools.js:helper"): "call",
        ("use.ts:run", "data/db.ts:Found"): "type",
    }


def test_symbols_and_places():
    rows = [dict(zip(COLUMNS, r, strict=True)) for r in facts("./lib/things/book.ts", STORE["lib/things/book.ts"].encode(), COLUMNS)]
    s = {r["name"]: r for r in rows if r["kind"] == "symbol"}
    assert set(s) == {"Book.constructor", "Book.store", "Book.tidy", "Shelf", "newBook", "each"}
    assert s["newBook"]["code"] == "newBook = (key: string) => new Book(key, 'untitled')" and s["newBook"]["lineno"] == 14
    assert s["Shelf"]["flag"] and (s["each"]["lineno"], s["each"]["end"]) == (15, 18)


@pytest.mark.parametrize(
    "code, names",
    [
        ("", []),
        ("}}} ) ] ` ${ ' /", []),
        ("function a( { if (", []),
        ("const a = x => x\nconst b = /[/`'\"{]/\nfunction c() {}", ["a", "c"]),
        ("let a = 5, b = function* () {}, c = async () => 1;", ["b", "c"]),
        ("namespace N.M { export function f() {} }\nswitch (x) { case 1: function no() {} }", ["N.M.f"]),
        ("describe('x', () => { function no() {} })\nfunction yes() { function inner() {} }", ["yes", "inner"]),
        ("declare function no(x: number): void;\nabstract class A { abstract no(): void; go<T>(x: { a: T }): Array<{ b: T }> { } }", ["A.go"]),
        ("export default function () {}\nexport default async function f() {}\nexport enum E { A }\ntype T = | { a: 1 }\n  | { b: 2 }\nfunction last() {}", ["f", "E", "T", "last"]),
    ],
)
def test_odd_sources(code, names):
    assert [r[COLUMNS.index("name")] for r in facts("./a.ts", code.encode(), COLUMNS) if r[0] == "symbol"] == names


def test_broken_configs_have_no_paths():
    at = COLUMNS.index("name")
    for content in (b"", b"[1", b"[]", b'{"compilerOptions": 3}', b'{"compilerOptions": null}'):
        assert [r[at] for r in config_facts("./tsconfig.json", content, COLUMNS)] == [None]


def test_index_of_both_languages(spark, tmp_path):
    for k, v in (STORE | {"tool/job.py": "def job():\n    return 1\n", "lib/a.min.js": "function no() {}", "lib/a.test.ts": "function no() {}", "static/b.js": "function no() {}"}).items():
        (tmp_path / k).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / k).write_text(v)
    ix = I.index_repository(spark, str(tmp_path))
    ids = {r.id for r in ix.symbols.collect()}
    assert {"./tool/job.py:job", "./lib/main.ts:main"} <= ids and not any(x.endswith(":no") for x in ids)
    hit = {r.id for r in I.blast(ix, spark.createDataFrame([("q", "./lib/text.ts:clip")], "query_id string, id string")).collect()}
    assert {"./lib/main.ts:main", "./lib/things/book.ts:Book.tidy", "./lib/things/book.ts:Book.store"} <= hit
    (tmp_path / "lib/text.ts").write_text(STORE["lib/text.ts"] + "export function fresh() { return clip('a'); }\n")
    new = I.update_index(ix, ["lib/text.ts"])
    edges = lambda x: {(r.src, r.dst) for r in x.edges.collect()}
    assert ("./lib/text.ts:fresh", "./lib/text.ts:clip") in edges(new)
    assert edges(new) == edges(I.index_repository(spark, str(tmp_path)))
