"""Facts of TypeScript and JavaScript files, by a tokenizer and a reader of declarations.

There is no full grammar here: declarations are read statement by statement, and what
lies in function bodies is scanned for calls. Rows have the columns of python_facts:

symbol: name, lineno, end, code; flag tells that it is a type (interface, alias, enum)
ts_class: name                       ts_base: owner (the class), name
ts_method: owner (the class), name   ts_field: owner, local (the field), name (its type)
ts_import: qualifier (specifier), local, name (null: default, ``*``: all), ord, doc
ts_export: qualifier, local (exported as), name, ord, doc    ts_star: qualifier, ord, doc
ts_use: owner (the symbol), cls (how), name, qualifier (a receiver's type), local (a receiver)
ts_config: file, qualifier (pattern; null: baseUrl), name (path below root), ord

doc of an import is the path below root that a relative specifier means. How a name is
used: ``call`` and ``new``, ``arg`` (passed on), ``super`` (name is the class), ``own`` (a
method of the own class, ``Class.method``), ``recv`` (name is the method) and ``ann`` (a
type in a signature or of a variable).
"""

from __future__ import annotations

import json
import posixpath
import re

EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
CONFIGS = ("tsconfig.json", "jsconfig.json")
_NAME = re.compile(r"[#@]?[^\W\d][\w$]*|[#@]?\$[\w$]*")
_NUMBER = re.compile(r"\d[\w.]*")
_OPERATOR = re.compile(r"=>|\?\.(?!\d)|\.\.\.|[=!]==?|&&=?|\|\|=?|\?\?=?|\+\+|--|[-+*/%&|^]=|<=|.", re.DOTALL)
_SPACE = re.compile(r"[\s﻿]+|//[^\n]*|/\*.*?(?:\*/|\Z)", re.DOTALL)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
#: Words after which a slash begins a regular expression, and which aren't callees.
_WORDS = frozenset("return typeof case in of delete void throw new else do instanceof yield await if for while switch catch function with export default extends import".split())
_MODIFIERS = frozenset("public private protected static async readonly abstract override declare get set accessor".split())
_ACCESS = frozenset(("public", "private", "protected"))
#: A line that begins or a line before it that ends with these goes on.
_GOES_ON = frozenset(". ?. ? : + - * / % = == === != !== && || ?? , ( [ ) ] => & | ^ < > <= += -= *= /= &&= ||= ??= ...".split())
_PLAIN = frozenset("string number boolean any unknown never void null undefined object symbol bigint this true false".split())
_CLOSE = {"(": ")", "[": "]", "{": "}"}
_TYPE_WORDS = frozenset("extends keyof typeof infer in is asserts readonly unique new as".split())


class _Tokens:
    """kinds (n name, s string, t template, d number, r regex, p punctuation), texts, places and lines, and the bracket that closes each."""

    def __init__(self, source: str):
        self.source, self.kind, self.text, self.start, self.end, self.line = source, [], [], [], [], []
        self._read()
        n = len(self.text)
        self.close, stack = [n - 1] * n, []
        for i in range(n):
            if self.kind[i] != "p":
                continue
            if self.text[i] in _CLOSE:
                stack.append(i)
            elif self.text[i] in ")]}":
                while stack:
                    j = stack.pop()
                    self.close[j] = i
                    if _CLOSE[self.text[j]] == self.text[i]:
                        break

    def _add(self, kind, text, start, end, line):
        for to, x in ((self.kind, kind), (self.text, text), (self.start, start), (self.end, end), (self.line, line)):
            to.append(x)

    def _read(self):
        s, at, line, n = self.source, 0, 1, len(self.source)
        inside = []  # depth of braces of each template's open expression
        if s.startswith("#!"):
            at = s.find("\n") if "\n" in s else n
        while at < n:
            c = s[at]
            if m := _SPACE.match(s, at):
                line += m.group().count("\n")
                at = m.end()
            elif c == "`" or c == "}" and inside and inside[-1] == 0:
                if c == "}":
                    inside.pop()
                    self._add("p", ")", at, at + 1, line)
                else:
                    self._add("t", "`", at, at + 1, line)
                at += 1
                while at < n and s[at] != "`" and not s.startswith("${", at):
                    line += s[at] == "\n"
                    at += 2 if s[at] == "\\" else 1
                if at < n and s[at] == "$":
                    inside.append(0)
                    self._add("p", "(", at, at + 2, line)
                    at += 2
                else:
                    at += 1
            elif m := _NAME.match(s, at):
                self._add("n", m.group(), at, m.end(), line)
                at = m.end()
            elif c.isdigit():
                at2 = _NUMBER.match(s, at).end()
                self._add("d", s[at:at2], at, at2, line)
                at = at2
            elif c in "'\"" and (end := self._string(at)):
                self._add("s", s[at + 1 : end - 1], at, end, line)
                line += s.count("\n", at, end)
                at = end
            elif c == "/" and self._regex_may_stand() and (m := _REGEX.match(s, at)):
                self._add("r", m.group(), at, m.end(), line)
                at = m.end()
            else:
                m = _OPERATOR.match(s, at)
                if inside and c in "{}":
                    inside[-1] += 1 if c == "{" else -1
                self._add("p", m.group(), at, m.end(), line)
                at = m.end()

    def _string(self, at):
        """The end of the string that begins here; 0 where its line ends first."""
        q, i = self.source[at], at + 1
        while i < len(self.source):
            c = self.source[i]
            if c == q:
                return i + 1
            if c == "\n":
                return 0
            i += 2 if c == "\\" else 1
        return 0

    def _regex_may_stand(self):
        if not self.text:
            return True
        if self.kind[-1] == "n":
            return self.text[-1] in _WORDS
        return self.kind[-1] == "p" and self.text[-1] not in (")", "]", "}", "++", "--")


class _Reader:
    """The declarations of a file."""

    def __init__(self, file: str, source: str):
        self.file, self.t = file, _Tokens(source)
        self.n = len(self.t.text)
        self.typed = file.endswith((".ts", ".tsx"))
        self.symbols: list[dict] = []
        self.classes: dict[str, dict] = {}
        self.imports: list[tuple] = []
        self.exports: list[tuple] = []
        self.stars: list[tuple] = []
        self.stack: list[str] = []
        self.walk(0, self.n, top=True)

    # Places

    def is_(self, i, text):
        return i < self.n and self.t.text[i] == text and self.t.kind[i] in "pn"

    def name_at(self, i):
        return self.t.text[i] if i < self.n and self.t.kind[i] == "n" else None

    def after_angles(self, i):
        """The place after ``<...>``, if that begins here."""
        if not self.is_(i, "<"):
            return i
        depth, j = 0, i
        while j < self.n:
            x = self.t.text[j] if self.t.kind[j] == "p" else ""
            if x in _CLOSE and x:
                j = self.t.close[j]
            elif x == "<":
                depth += 1
            elif x == ">":
                depth -= 1
                if not depth:
                    return j + 1
            elif x == ";":
                return i
            j += 1
        return i

    def after_type(self, i, end, stops):
        """The place after a type: at one of stops, outside of brackets."""
        j, fresh = i, True
        while j < end:
            x = self.t.text[j] if self.t.kind[j] == "p" else ""
            if x in stops and not (x == "{" and fresh):
                return j
            if j > i and not fresh and self.t.line[j] > self.t.line[j - 1] and x not in _GOES_ON and self.t.text[j - 1] not in _GOES_ON:
                return j
            fresh = x in ("=>", "|", "&", ":", "<", ",", "?", "=") or self.t.text[j] in _TYPE_WORDS
            if x == "<":
                k = self.after_angles(j)
                fresh = k == j
                j = k if k > j else j + 1
            elif x in _CLOSE and x:
                j = self.t.close[j] + 1
            else:
                j += 1
        return end

    def statement_end(self, i, end, stops=(";",)):
        """The place where the expression or statement from i ends, by a stop or its line's end."""
        j = i
        while j < end:
            t, x = self.t, self.t.text[j] if self.t.kind[j] == "p" else ""
            if x in stops or x and x in ")]}":
                return j
            if j > i and t.line[j] > t.line[j - 1] and x not in _GOES_ON and t.kind[j] != "t" and not (t.kind[j - 1] == "p" and t.text[j - 1] in _GOES_ON - {")", "]", "}"}) and t.text[j] not in ("instanceof", "in", "as"):
                return j
            j = t.close[j] + 1 if x in _CLOSE and x else j + 1
        return end

    # Statements

    def walk(self, i, end, top=False):
        while i < end:
            i = max(self.statement(i, end, top), i + 1)

    def statement(self, i, end, top):
        t, x = self.t, self.t.text[i]
        if t.kind[i] != "n":
            if t.kind[i] == "p" and x == "{":
                self.walk(i + 1, t.close[i])
                return t.close[i] + 1
            if t.kind[i] == "p" and x in ";})]":
                return i + 1
            if t.kind[i] == "p" and x == "@":
                return i + 1
            return self.statement_end(i, end)
        if x[0] == "@":  # a decorator
            j = i + 1
            while self.is_(j, "."):
                j += 2
            return t.close[j] + 1 if self.is_(j, "(") else j
        if x == "import" and top and not self.is_(i + 1, "(") and not self.is_(i + 1, "."):
            return self.read_import(i, end)
        if x == "export":
            return self.read_export(i, end, top)
        if x in ("declare", "abstract") and self.name_at(i + 1) or x == "async" and self.is_(i + 1, "function"):
            return i + 1
        if x == "function":
            return self.read_function(i, end, i - 1 if i and self.is_(i - 1, "async") else i)
        if x == "class" and self.name_at(i + 1):
            return self.read_class(i, end, i - 1 if i and self.is_(i - 1, "abstract") else i)
        if x == "interface" and self.name_at(i + 1) and not self.is_(i + 1, "in"):
            j = i + 2
            while j < end and not self.is_(j, "{"):
                j = max(self.after_angles(j), j + 1)
            return self.add_type(i, t.close[j] if j < end else end - 1)
        if x == "type" and self.name_at(i + 1) and (self.is_(i + 2, "=") or self.is_(i + 2, "<")):
            j = self.after_angles(i + 2)
            j = self.after_type(j + 1, end, (";",))
            return self.add_type(i, j if self.is_(j, ";") else j - 1)
        if x == "enum" and self.name_at(i + 1) and self.is_(i + 2, "{"):
            return self.add_type(i, t.close[i + 2], i - 1 if i and self.is_(i - 1, "const") else i)
        if x == "namespace" and self.name_at(i + 1):
            j = i + 2
            while self.is_(j, "."):
                j += 2
            if self.is_(j, "{"):
                self.stack.append("".join(t.text[i + 1 : j]))
                self.walk(j + 1, t.close[j])
                self.stack.pop()
                return t.close[j] + 1
        if x in ("const", "let", "var"):
            return i + 1 if self.is_(i + 1, "enum") else self.read_variables(i, end)
        if x in ("if", "for", "while", "with"):
            j = i + 1 + self.is_(i + 1, "await")
            return t.close[j] + 1 if self.is_(j, "(") else self.statement_end(i, end)
        if x in ("do", "try"):
            return i + 1
        if x in ("else", "catch", "finally", "switch"):  # what they hold isn't indexed
            j = i + 1
            if self.is_(j, "if"):
                j += 1
            if self.is_(j, "("):
                j = t.close[j] + 1
            return t.close[j] + 1 if self.is_(j, "{") else self.statement_end(j, end)
        if self.is_(i + 1, ":"):
            return i + 2
        return self.statement_end(i, end)

    def meant(self, spec):
        return posixpath.normpath(posixpath.join(posixpath.dirname(self.file), spec)) if spec.startswith(".") else None

    def _bindings(self, i):
        """(name, local) pairs of ``{ a, b as c }``."""
        t, j, stop, out = self.t, i + 1, self.t.close[i], []
        while j < stop:
            if self.is_(j, "type") and self.name_at(j + 1) and not self.is_(j + 1, "as"):
                j += 1
            if t.kind[j] in "ns":
                name = local = t.text[j]
                if self.is_(j + 1, "as"):
                    local = t.text[j + 2]
                    j += 2
                out.append((name, local))
            j += 1
        return out

    def read_import(self, i, end):
        t, j, found = self.t, i + 1, []
        if self.is_(j, "type") and not self.is_(j + 1, "from") and not self.is_(j + 1, ","):
            j += 1
        while j < end and t.kind[j] != "s":
            if self.is_(j, "{"):
                found += self._bindings(j)
                j = t.close[j]
            elif self.is_(j, "*") and self.is_(j + 1, "as"):
                found.append(("*", t.text[j + 2]))
                j += 2
            elif self.is_(j, ";") or self.is_(j, "="):
                return self.statement_end(j, end)
            elif t.kind[j] == "n" and t.text[j] != "from":
                found.append((None, t.text[j]))
            j += 1
        if j < end:
            self.imports += [(t.text[j], local, name) for name, local in found]
        return self.statement_end(j, end)

    def read_export(self, i, end, top):
        t, j = self.t, i + 1
        if self.is_(j, "type") and (self.is_(j + 1, "{") or self.is_(j + 1, "*")):
            j += 1
        if self.is_(j, "{"):
            k = t.close[j] + 1
            if top and self.is_(k, "from") and k + 1 < end and t.kind[k + 1] == "s":
                self.exports += [(t.text[k + 1], local, name) for name, local in self._bindings(j)]
            return self.statement_end(k, end)
        if self.is_(j, "*"):
            while j < end and t.kind[j] != "s":
                j += 1
            if top and j < end:
                self.stars.append((t.text[j],))
            return self.statement_end(j, end)
        if self.is_(j, "default"):
            j += 1
            return j if self.name_at(j) in ("function", "class", "async", "abstract", "interface") else self.statement_end(j, end)
        return self.statement_end(j, end) if self.is_(j, "=") else j

    def add(self, name, first, last, **more):
        self.symbols.append({"name": ".".join((*self.stack, name)), "first": first, "last": last, "cls": None, "params": None, "ret": None, "body": None, "type": False, **more})

    def add_type(self, i, last, first=None):
        self.add(self.t.text[i + 1], i if first is None else first, last, type=True)
        return last + 1

    def read_function(self, i, end, first):
        t, j = self.t, i + 1
        if self.is_(j, "*"):
            j += 1
        name = self.name_at(j)
        j = self.after_angles(j + 1) if name else j
        if not self.is_(j, "("):
            return self.statement_end(j, end)
        params, k = j, t.close[j] + 1
        ret = None
        if self.is_(k, ":"):
            ret = (k + 1, self.after_type(k + 1, end, ("{", ";")))
            k = ret[1]
        if not self.is_(k, "{"):
            return k
        if name:
            self.add(name, first, t.close[k], params=params, ret=ret, body=(k, t.close[k]))
            self.walk(k + 1, t.close[k])
        return t.close[k] + 1

    def read_variables(self, i, end):
        t, j = self.t, i + 1
        while j < end:
            if t.kind[j] != "n":  # a pattern
                k = t.close[j] + 1 if t.text[j] in _CLOSE else j + 1
                k = self.after_type(k + 1, end, ("=", ",", ";")) if self.is_(k, ":") else k
                j = self.statement_end(k, end, (";", ","))
            else:
                k = j + 1
                if self.is_(k, "!"):
                    k += 1
                if self.is_(k, ":"):
                    k = self.after_type(k + 1, end, ("=", ",", ";"))
                k = self.read_value(j, k + 1, end) if self.is_(k, "=") else k
                j = self.statement_end(k, end, (";", ","))
            if not self.is_(j, ","):
                return j
            j += 1
        return j

    def read_value(self, first, i, end):
        """A variable's value; a function makes the variable a symbol. The place after a function's body, else i."""
        t, j = self.t, i + self.is_(i, "async") * (not self.is_(i + 1, "=>"))
        if self.is_(j, "function"):
            j += 1
            if self.is_(j, "*"):
                j += 1
            j = self.after_angles(j + 1 if self.name_at(j) else j)
            if not self.is_(j, "("):
                return i
            params, k, ret = j, t.close[j] + 1, None
            if self.is_(k, ":"):
                ret = (k + 1, self.after_type(k + 1, end, ("{",)))
                k = ret[1]
            if not self.is_(k, "{"):
                return i
        else:
            j = self.after_angles(j)
            if self.is_(j, "("):
                params, k, ret = j, t.close[j] + 1, None
                if self.is_(k, ":"):
                    ret = (k + 1, self.after_type(k + 1, end, ("=>", ";")) if not self.is_(k + 1, "(") else t.close[k + 1] + 1)
                    k = ret[1]
            elif self.name_at(j) and self.is_(j + 1, "=>"):
                params, k, ret = None, j + 1, None
            else:
                return i
            if not self.is_(k, "=>"):
                return i
            k += 1
        if self.is_(k, "{"):
            last = t.close[k]
            self.add(t.text[first], first, last, params=params, ret=ret, body=(k, last))
            self.walk(k + 1, last)
            return last + 1
        stop = self.statement_end(k, end, (";", ","))
        self.add(t.text[first], first, stop - 1, params=params, ret=ret, body=(k, stop - 1))
        return stop

    def read_class(self, i, end, first):
        t, name, j = self.t, self.t.text[i + 1], self.after_angles(i + 2)
        base = None
        while j < end and not self.is_(j, "{"):
            if self.is_(j, "extends") and self.name_at(j + 1):
                k = self.after_angles(j + 2)
                if self.is_(k, "{") or self.is_(k, "implements"):
                    base = t.text[j + 1]
                j = k
            else:
                j = max(self.after_angles(j), j + 1)
        if j >= end:
            return end
        qualified = ".".join((*self.stack, name))
        # in plain scripts a base isn't told apart from any expression
        c = self.classes[qualified] = {"base": base if self.typed else None, "methods": self.classes.get(qualified, {}).get("methods", set()), "fields": {}}
        self.stack.append(name)
        stop, i = t.close[j], j + 1
        while i < stop:
            i = max(self.member(i, stop, qualified, c), i + 1)
        self.stack.pop()
        return stop + 1

    def member(self, i, stop, qualified, c):
        t, j = self.t, i
        if self.is_(j, ";"):
            return j + 1
        if self.name_at(j) and t.text[j][0] == "@":
            return self.statement(j, stop, False)
        while self.name_at(j) in _MODIFIERS and not any(self.is_(j + 1, x) for x in ("(", "=", ":", ";", "?", "!", "<", "}", ",")):
            j += 1
        if self.is_(j, "*"):
            j += 1
        if self.is_(j, "{"):
            return t.close[j] + 1
        at = j
        last = t.close[j] if self.is_(j, "[") else j
        name = t.source[t.start[at] : t.end[last]]
        j = last + 1
        while self.is_(j, "?") or self.is_(j, "!"):
            j += 1
        k = self.after_angles(j)
        if self.is_(k, "("):
            params, k, ret = k, t.close[k] + 1, None
            if self.is_(k, ":"):
                ret = (k + 1, self.after_type(k + 1, stop, ("{", ";")))
                k = ret[1]
            if not self.is_(k, "{"):
                return k
            self.add(name, i, t.close[k], cls=qualified, params=params, ret=ret, body=(k, t.close[k]))
            c["methods"].add(name)
            if name == "constructor":
                c["fields"].update((p, ty) for p, ty, is_field in self.parameters(params) if is_field and ty)
            self.walk(k + 1, t.close[k])
            return t.close[k] + 1
        if self.is_(j, ":"):
            k = self.after_type(j + 1, stop, ("=", ";"))
            if self.typed and (ty := self.type_name(j + 1, k)):
                c["fields"][name] = ty
            j = k
        return self.statement_end(j, stop) if self.is_(j, "=") else j

    # Types

    def type_name(self, i, end):
        """The name of ``User``, ``Repo<User>`` or ``ns.User``; None of other types."""
        if not self.name_at(i) or i >= end or self.t.text[i] in _PLAIN or self.t.text[i] in _TYPE_WORDS:
            return None
        j, name = i + 1, self.t.text[i]
        dotted = False
        while self.is_(j, ".") and j < end:
            name, dotted, j = self.t.text[j + 1], True, j + 2
        k = self.after_angles(j)
        return name if k >= end and not (dotted and k > j) else None

    def type_names(self, i, end):
        """Every name of a type in a signature's part."""
        t, out = self.t, set()
        for j in range(i, min(end, self.n)):
            if t.kind[j] == "n" and t.text[j] not in _PLAIN and t.text[j] not in _TYPE_WORDS and not self.is_(j + 1, ".") and not (self.is_(j + 1, ":") or self.is_(j + 1, "?") and self.is_(j + 2, ":")):
                out.add(t.text[j])
        return out

    def _parts(self, i):
        """(first, end) of what stands between the commas of a bracket."""
        t, stop = self.t, self.t.close[i]
        a = j = i + 1
        while j < stop:
            x = t.text[j] if t.kind[j] == "p" else ""
            if x == ",":
                yield a, j
                a = j + 1
            if x == "<":
                j = max(self.after_angles(j), j + 1)
            else:
                j = t.close[j] + 1 if x in _CLOSE and x else j + 1
        if a < stop:
            yield a, stop

    def parameters(self, i):
        """(name, type, whether it is a field) of simple parameters."""
        if i is None:
            return
        t = self.t
        for a, b in self._parts(i):
            access = False
            while self.name_at(a) and a + 1 < b and (t.text[a] in _MODIFIERS or t.text[a][0] == "@") and not self.is_(a + 1, ":") and not self.is_(a + 1, "?") and not self.is_(a + 1, "="):
                access |= t.text[a] in _ACCESS
                a = t.close[a + 1] + 1 if t.text[a][0] == "@" and self.is_(a + 1, "(") else a + 1
            if not self.name_at(a) or a >= b or not self.typed and a + 1 < b:
                continue
            k = a + 1 + self.is_(a + 1, "?")
            ty = self.type_name(k + 1, self.after_type(k + 1, b, ("=",))) if self.is_(k, ":") else None
            yield t.text[a], ty, access

    def signature_types(self, s):
        out = set()
        if s["params"] is not None:
            for a, b in self._parts(s["params"]):
                j = a
                while j < b and not self.is_(j, ":") and not self.is_(j, "="):
                    j = self.t.close[j] + 1 if self.t.text[j] in _CLOSE else j + 1
                if self.is_(j, ":"):
                    out |= self.type_names(j + 1, self.after_type(j + 1, b, ("=",)))
        if s["ret"]:
            out |= self.type_names(*s["ret"])
        return out

    # Uses

    def uses(self, s, inner):
        """(how, name, type, receiver) of what a symbol uses; inner: symbols that begin at a token."""
        if s["type"]:
            return
        t, n = self.t, self.n
        info = {p: ty for p, ty, _ in self.parameters(s["params"])} if s["params"] is not None else {}
        own = s["name"].rpartition(".")[0] or None
        body, local, calls, heads = s["body"], {}, [], set()
        j, stop = body
        while j <= stop and j < n:
            other = inner.get(j)
            if other is not None and other is not s and other["first"] >= body[0]:
                j = other["last"] + 1
                continue
            if t.kind[j] == "n":
                if t.text[j] in ("const", "let", "var"):
                    head = j + 1
                    while head <= stop:
                        heads.add(head)
                        comma = self.statement_end(head, stop + 1, (";", ","))
                        head = comma + 1 if self.is_(comma, ",") else stop + 1
                if j in heads and (got := self._local_type(j, stop)):
                    local[t.text[j]] = got
                before = t.text[j - 1] if j > body[0] and t.kind[j - 1] in "pn" else ""
                k = self.after_angles(j + 1)
                if self.typed and k > j + 1 and not self.is_(k, "("):
                    k = j + 1
                k += self.is_(k, "?.") and self.is_(k + 1, "(")
                called = k < n and (self.is_(k, "(") or t.kind[k] == "t" and k == j + 1)
                if before == "new":
                    if called or not self.is_(j + 1, "."):
                        calls.append(("new", t.text[j], None, None))
                elif called and t.text[j] == "super":
                    calls.append(("super", own, None, None))
                elif called and t.text[j] not in _WORDS and before not in ("function", "class"):
                    calls.append((before, j, None, None))
                if called and self.is_(k, "(") and before != "new" and t.text[j] not in _WORDS - {"import"}:
                    calls += [("arg", t.text[a], None, None) for a, b in self._parts(k) if b == a + 1 and self.name_at(a)]
            elif t.kind[j] == "p" and t.text[j] == "(" and j > body[0] and t.kind[j - 1] == "p" and t.text[j - 1] in (")", "]"):  # a call of what a call gave
                if not (self.is_(j - 1, ")") and self._is_head(j - 1, body[0])):
                    calls += [("arg", t.text[a], None, None) for a, b in self._parts(j) if b == a + 1 and self.name_at(a)]
            j += 1
        for how, x, ty, recv in calls:
            if how in ("arg", "new"):
                if x not in info and x not in _PLAIN and x not in _WORDS:
                    yield how, x, ty, recv
            elif how == "super":
                if own:
                    yield how, x, ty, recv
            elif how not in (".", "?."):
                if t.text[x] not in info and t.text[x] not in ("this", "import", "require"):
                    yield "call", t.text[x], None, None
            else:
                yield from self._member_use(x, own, info, local)
        names = self.signature_types(s) | {v for v in info.values() if v} | set(local.values())
        yield from (("ann", x, None, None) for x in sorted(names))

    def _is_head(self, j, first):
        """Whether the bracket that closes at j follows a keyword like ``if``."""
        for i in range(j - 1, first, -1):
            if self.t.close[i] == j and self.is_(i, "("):
                return self.name_at(i - 1) in _WORDS
        return False

    def _local_type(self, j, stop):
        k = j + 1 + self.is_(j + 1, "!")
        if self.is_(k, ":"):
            e = self.after_type(k + 1, stop + 1, ("=", ",", ";"))
            if got := self.type_name(k + 1, e):
                return got
            k = e
        if self.is_(k, "=") and self.is_(k + 1, "new") and self.name_at(k + 2) and not self.is_(k + 3, "."):
            return self.t.text[k + 2]
        return None

    def _member_use(self, j, own, info, local):
        t, method = self.t, self.t.text[j]
        obj = self.name_at(j - 2)
        before = t.text[j - 3] if j >= 3 and t.kind[j - 3] == "p" else ""
        if obj == "this" and before not in (".", "?."):
            if own and method in self.classes.get(own, {}).get("methods", ()):
                yield "own", f"{own}.{method}", None, None
        elif obj and before not in (".", "?."):
            yield "recv", method, local.get(obj) or info.get(obj), obj
        elif obj and own and self.name_at(j - 4) == "this" and not (j >= 5 and t.text[j - 5] in (".", "?.")):
            if ty := self.classes.get(own, {}).get("fields", {}).get(obj):
                yield "recv", method, ty, None


def facts(file: str, content: bytes, columns: tuple) -> list[tuple]:
    """The rows of one file."""
    rows = []

    def row(kind, **have):
        rows.append(tuple({"kind": kind, "file": file, **have}.get(c) for c in columns))

    source = (content or b"").decode("utf-8", "ignore")
    if source.encode() != (content or b""):
        row("encoding")
    try:
        r = _Reader(file, source)
    except RecursionError as e:
        row("broken", name=f"RecursionError: {e}"[:200])
        return rows
    t = r.t
    last = {s["name"]: s for s in r.symbols}
    for name, s in last.items():
        row("symbol", name=name, lineno=t.line[s["first"]], end=t.line[s["last"]], code=source[t.start[s["first"]] : t.end[s["last"]]], flag=s["type"])
    for name, c in r.classes.items():
        row("ts_class", name=name)
        if c["base"]:
            row("ts_base", owner=name, name=c["base"])
        for m in sorted(c["methods"]):
            row("ts_method", owner=name, name=m)
        for f, ty in c["fields"].items():
            row("ts_field", owner=name, local=f, name=ty)
    for kind, found in (("ts_import", r.imports), ("ts_export", r.exports), ("ts_star", r.stars)):
        for i, (spec, *names) in enumerate(found):
            row(kind, qualifier=spec, ord=i, doc=r.meant(spec), **dict(zip(("local", "name"), names, strict=False)))
    inner = {}
    for s in r.symbols:
        inner.setdefault(s["first"], s)
    for s in r.symbols:
        for how, name, ty, recv in dict.fromkeys(r.uses(s, inner)):
            row("ts_use", owner=s["name"], cls=how, name=name, qualifier=ty, local=recv)
    return rows


_COMMENT = re.compile(r'("(?:[^"\\\n]|\\.)*")|//[^\n]*|/\*.*?\*/', re.DOTALL)


def config_facts(file: str, content: bytes, columns: tuple) -> list[tuple]:
    """The paths of a tsconfig.json or jsconfig.json, which may have comments and trailing commas; no row of a path if it can't be read."""
    text = _COMMENT.sub(lambda m: m.group(1) or "", (content or b"").decode("utf-8", "ignore"))
    text = re.sub(r",\s*([}\]])", r"\1", text)
    try:
        options = json.loads(text).get("compilerOptions") or {}
        base, paths = options.get("baseUrl") or "", options.get("paths") or {}
        found = [(k, x) for k, v in paths.items() if isinstance(v, list) for x in v if isinstance(x, str)]
    except (ValueError, AttributeError):
        base, found = "", []
    top = posixpath.normpath(posixpath.join(posixpath.dirname(file), base))
    out = [(k, posixpath.normpath(posixpath.join(top, x)), i) for i, (k, x) in enumerate(found)]
    if base:
        out.append((None, top, len(out)))
    have = [{"qualifier": k, "name": x, "ord": i} for k, x, i in out] or [{}]
    return [tuple({"kind": "ts_config", "file": file, **h}.get(c) for c in columns) for h in have]
