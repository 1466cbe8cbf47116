"""Facts, names and edges of small repositories written here."""

import textwrap

import pytest

from tidewake.functions.python_facts import COLUMNS, facts
from tidewake.operators import resolve


def files(spark, sources):
    return spark.createDataFrame([(f"./{k}", textwrap.dedent(v).encode()) for k, v in sources.items()], "rel_file string, content binary")


def graph(spark, sources):
    f = files(spark, sources)
    return {(r.src.removeprefix("./"), r.dst.removeprefix("./")): r.kind for r in resolve.repository_edges(resolve.extract_facts(f), f).collect()}


SHOP = {
    "shapes.py": """
        class Person:
            def __init__(self, label):
                self.label = label

            def title(self):
                return self.label.upper()


        class Basket:
            def __init__(self, person, amount):
                self.person = person

            def line(self):
                return self.person.title()
        """,
    "rules.py": """
        def good_mail(mail):
            return "@" in mail

        def above_zero(n):
            return n > 0
        """,
    "desk.py": """
        from .shapes import Person, Basket
        from .rules import good_mail, above_zero

        def new_person(label, mail):
            if not good_mail(mail):
                raise ValueError
            return Person(label)

        def new_basket(person, amount):
            if not above_zero(amount):
                raise ValueError
            basket = Basket(person, amount)
            return basket.line()

        def welcome(label, mail, amount):
            person = new_person(label, mail)
            return new_basket(person, amount)
        """,
}


def test_calls_across_files(spark):
    g = graph(spark, SHOP)
    calls = {e for e, kind in g.items() if kind == "call"}
    assert calls == {
        ("desk.py:new_person", "rules.py:good_mail"), ("desk.py:new_basket", "rules.py:above_zero"), ("desk.py:new_basket", "shapes.py:Basket.line"),
        ("desk.py:welcome", "desk.py:new_person"), ("desk.py:welcome", "desk.py:new_basket"),
    }
    assert len(g) == 28 and all(a != b for a, b in g)
    assert ("shapes.py:Person.__init__", "shapes.py:Basket.line") in g


LAYOUT = {
    "src/kit/__init__.py": """
        from .tools import tool
        from kit.deep import deep_one

        def top():
            return 1
        """,
    "src/kit/deep.py": "def deep_one():\n    return 2\n",
    "src/kit/tools.py": "def tool():\n    return 3\n",
    "src/use/__init__.py": "",
    "src/use/app.py": """
        import kit
        import kit.deep
        from kit import tool as hammer, deep_one

        def a():
            return kit.top()

        def b():
            return kit.deep_one()

        def c():
            return kit.tool()

        def d():
            return kit.deep.deep_one()

        def runs(task, xs):
            return [task(x) for x in xs]

        def e():
            return runs(kit.deep_one, [1])

        def f(xs):
            return sorted(xs, key=kit.top)

        def g(deep_one):
            return runs(deep_one, [1])

        def h():
            return hammer(), deep_one()
        """,
}


def test_packages_below_src(spark):
    calls = {e for e, kind in graph(spark, LAYOUT).items() if kind == "call" and e[0].startswith("src/use")}
    u = "src/use/app.py:"
    assert calls >= {
        (u + "a", "src/kit/__init__.py:top"), (u + "b", "src/kit/deep.py:deep_one"), (u + "c", "src/kit/tools.py:tool"), (u + "d", "src/kit/deep.py:deep_one"), (u + "e", u + "runs"), (u + "e", "src/kit/deep.py:deep_one"),
        (u + "f", "src/kit/__init__.py:top"), (u + "h", "src/kit/deep.py:deep_one"),
    }
    assert (u + "g", "src/kit/deep.py:deep_one") not in calls
    # an alias names the file; the function there has another name
    assert (u + "h", "src/kit/tools.py:tool") not in calls


FAMILY = {
    "base/store.py": "class Store:\n    def get(self, k):\n        return None\n\n    def _key(self, k):\n        return k\n",
    "disk/disk.py": """
        from base.store import Store

        class Disk(Store):
            def get(self, k):
                return self._key(k)

            def sync(self):
                return 1

            def __repr__(self):
                return ""
        """,
    "net/net.py": """
        from base import store

        class Net(store.Store):
            def get(self, k):
                return 2

            def sync(self):
                return 3

            def __repr__(self):
                return ""
        """,
    "use/main.py": """
        from disk.disk import Disk
        import functools

        def traced(fn):
            return fn

        def make():
            return Disk()

        shared = make()

        class Holder:
            def __init__(self):
                self.disk = make()

            def read(self):
                return self.disk.get(1)

        @traced
        def load():
            d = make()
            return d.sync(), shared.get(2)

        @functools.wraps
        @traced
        def other(d: Disk):
            return d._key(1)
        """,
}


def test_inheritance_factories_and_decorators(spark):
    g = graph(spark, FAMILY)
    kind = lambda a, b: g.get((a, b))
    assert kind("disk/disk.py:Disk.get", "base/store.py:Store._key") == "call"
    assert kind("disk/disk.py:Disk.get", "base/store.py:Store.get") == "override" and kind("net/net.py:Net.get", "base/store.py:Store.get") == "override"
    assert kind("base/store.py:Store.get", "net/net.py:Net.get") == "child"
    assert kind("disk/disk.py:Disk.sync", "net/net.py:Net.sync") == kind("net/net.py:Net.sync", "disk/disk.py:Disk.sync") == "sibling"
    assert kind("disk/disk.py:Disk.__repr__", "net/net.py:Net.__repr__") is None
    m = "use/main.py:"
    assert kind(m + "load", "disk/disk.py:Disk.sync") == kind(m + "load", "disk/disk.py:Disk.get") == kind(m + "load", m + "make") == "call"
    assert kind(m + "Holder.read", "disk/disk.py:Disk.get") == kind(m + "other", "base/store.py:Store._key") == "call"
    assert kind(m + "load", m + "traced") == kind(m + "other", m + "traced") == "decorator"


def test_large_families_make_no_pairs(spark):
    sources = {"b/base.py": "class Base:\n    pass\n"} | {f"i{i}/x.py": "from b.base import Base\n" for i in range(9)} | {f"k{i}/m{i}.py": f"from b.base import Base\nclass C{i}(Base):\n    def go(self):\n        return {i}\n" for i in range(8)}
    assert not {e for e, kind in graph(spark, sources).items() if kind == "sibling"}
    few = {k: v for k, v in sources.items() if not k.startswith(("k6", "k7"))}
    assert len({e for e, kind in graph(spark, few).items() if kind == "sibling"}) == 30


def rows(source, kind):
    at = {c: i for i, c in enumerate(COLUMNS)}
    return [{c: r[at[c]] for c in COLUMNS if r[at[c]] is not None} for r in facts("./x.py", source) if r[0] == kind]


def test_symbols_of_hard_files():
    source = b"\xef\xbb\xbfif True:\n    def f():\n        return '\xc3\xa9'\nelse:\n    def f():\n        return 2\nclass A:\n    class B:\n        def m(self): return 1 # \xc3\xa9\ntry:\n    pass\nexcept E:\n    async def g():\n        def inner():\n            return 0\n"
    s = rows(source, "symbol")
    assert [(x["name"], x["lineno"]) for x in s] == [("f", 5), ("A.B.m", 9), ("g", 13), ("inner", 14)]
    assert s[0]["code"] == "def f():\n        return 2" and s[1]["code"] == "def m(self): return 1"
    assert [x["name"] for x in rows(b"def f(:\n", "broken")] and rows(b"\x00", "broken") and rows(b"x = '\xff'\n", "encoding")
    assert rows(b"", "symbol") == [] and rows(None, "symbol") == []
    assert rows(b"def f():\r\n    return 1\r\n", "symbol")[0]["code"].startswith("def f():")
    assert rows(b'"""Head line.\n\nmore"""\n', "doc")[0]["code"] == "Head line."


@pytest.mark.parametrize("source,want", [
    ("def f():\n    if 1:\n        return A()\n    return A()\n", (None, "A")), ("def f():\n    if 1:\n        return A()\n    return B()\n", None), ("def f() -> Optional[m.A]:\n    return x\n", ("m", "A")), ("def f() -> int:\n    return x\n", None),
])
def test_return_types(source, want):
    got = rows(source.encode(), "factory")
    assert [(x.get("qualifier"), x["name"]) for x in got] == ([want] if want else [])


def test_no_files(spark):
    assert resolve.repository_edges(resolve.extract_facts(files(spark, SHOP).limit(0)), files(spark, SHOP).limit(0)).count() == 0
