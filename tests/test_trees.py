"""Ignore layers against a plain walk, extractors on snippets with traps, the parse cache."""

import fnmatch
import random
import re
import time

import pytest

from spanwood.plans.trees import IGNORES
from spanwood.sources import extract as E
from spanwood.sources import ignore as G
from spanwood.sources.cache import ParseCache

NAMES = ["src", "vendor", "build", "a", "b", "main.go", "x.py", "go.sum", "y.min.js", "z.log", "k.ts", "node_modules"]


def fits(line, folder, entry, is_folder):
    """Whether a pattern of a folder's ignore file fits an entry, segment by segment; and whether it lets in."""
    lets_in = line.startswith("!")
    line = line.removeprefix("!")
    if line.endswith("/"):
        if not is_folder:
            return None
        line = line[:-1]
    if folder and not entry.startswith(folder + "/"):
        return None
    parts = entry[len(folder) + 1 if folder else 0 :].split("/")
    globs = line.removeprefix("/").split("/")

    def match(g, p):
        if not g:
            return not p
        if g[0] == "**":
            return bool(p) if len(g) == 1 else any(match(g[1:], p[k:]) for k in range(len(p)))
        return bool(p) and fnmatch.fnmatchcase(p[0], g[0]) and match(g[1:], p[1:])

    return lets_in if (match(globs, parts) if "/" in line else match(globs, parts[-1:])) else None


def said(layer, rules, entry, is_folder):
    out = None
    for folder, kind, text in sorted(rules, key=lambda r: r[0].count("/") + bool(r[0])):
        if kind == layer and (not folder or entry.startswith(folder + "/")):
            for line in text.split("\n"):
                if line and not line.startswith("#") and (found := fits(line, folder, entry, is_folder)) is not None:
                    out = found
    return out


def walked(paths, rules):
    """The files that a walk from the root downwards meets."""
    tree = {}
    for p in paths:
        at = tree
        for part in p.split("/")[:-1]:
            at = at.setdefault(part, {})
        at[p.split("/")[-1]] = None
    out = []

    def walk(folder, at):
        for name, below in at.items():
            entry, is_folder = f"{folder}/{name}" if folder else name, below is not None
            own = said("own", rules, entry, is_folder)
            listed = name in G.SKIPPED_FOLDERS if is_folder else name in G.SKIPPED_NAMES or re.search(r"\.min\.(js|css)$", name) or ("." + name.rpartition(".")[2]).lower() in G.SKIPPED_EXTENSIONS
            if own is False or (listed and not own) or said("git", rules, entry, is_folder) is False:
                continue
            if is_folder:
                walk(entry, below)
            elif name.rpartition(".")[2] in ("go", "py", "js", "ts"):
                out.append(entry)

    walk("", tree)
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_layers_as_a_walk(spark, seed):
    rng = random.Random(seed)
    folders = ["a", "b", "src", "vendor", "build", "node_modules", "c"]
    paths = sorted({"/".join([*(rng.choice(folders) for _ in range(rng.randint(0, 3))), rng.choice([n for n in NAMES if "." in n])]) for _ in range(120)})
    patterns = ["!vendor/", "*.py", "!x.py", "/a/", "b/**", "**/b", "a/**/k.ts", "src/*.go", "!build/", "k.?s", "[xyz].*", "!go.sum", "# note", "", "!node_modules", "/src/a", "!*.min.js"]
    rules = [(folder, layer, "\n".join(rng.choice(patterns) for _ in range(3))) for folder in ("", "a", "src", "a/b") for layer in ("own", "git") if rng.random() < 0.7]
    files = spark.createDataFrame([*((p, 10) for p in paths), (None, 1)], "path string, size long")
    got = G.collected(files, spark.createDataFrame(rules, "folder string, layer string, text string"))
    assert sorted(r.path for r in got.collect()) == walked(paths, rules)


def test_rules():
    def ok(line, path, folder="", is_folder=False):
        regex, _, only = G.rule_regex(line, folder)
        return bool(re.fullmatch(regex, path)) and (is_folder or not only)

    assert ok("*.log", "x/y.log") and not ok("*.log", "x/y.logs") and ok("/y", "y") and not ok("/y", "x/y") and ok("x/y", "x/y") and not ok("x/y", "z/x/y")
    assert ok("**/y", "a/b/y") and ok("**/y", "y") and ok("a/**", "a/b/c") and not ok("a/**", "a") and ok("a/**/c", "a/c") and ok("a/**/c", "a/b/d/c")
    assert ok("b/", "a/b", is_folder=True) and not ok("b/", "a/b") and ok("y", "p/x/y", "p") and not ok("/x", "p/y/x", "p") and ok("[!a]?", "bc") and not ok("[!a]?", "ac")
    assert ok(r"\!x", "!x") and ok(r"\#x", "#x") and ok("a+b.(c", "a+b.(c") and G.rule_regex("  ", "") is None and G.rule_regex("# x", "") is None and G.rule_regex("/", "") is None
    assert IGNORES


SNIPPETS = {
    "python": ("import os, sys as s\nfrom a.b import (x as y,\n  z)\nclass C(Base, metaclass=M):\n    '''class D: def e(): pass'''\n    def m(self):\n        s = 'def n():'\n        return f2(s) # call z()\n\n@dec(1)\ndef f(a,\n        b=')'):\n    def inner(): pass\n    return C().m()\n",
               [("class", "C", 4, 8, None, True), ("method", "m", 6, 8, "C", True), ("function", "f", 11, 14, None, True), ("function", "inner", 13, 13, None, True)],
               {("f2", None, "m"), ("dec", None, None), ("C", None, "f"), ("m", "()", "f")}, {("os", "*"), ("sys", "*"), ("a.b", "x"), ("a.b", "z")}, {("C", "extends", "Base")}),
    "go": ('package p\nimport (\n "fmt"\n x "os/exec"\n)\n// func c() {\ntype C struct {\n a string // }\n}\nfunc (c *C) M(s string) error {\n x := "func e() {"\n return fmt.Errorf(x + `}`)\n}\ntype I interface { Do(x int) error }\n',
           [("class", "C", 7, 9, None, True), ("method", "M", 10, 13, "C", True), ("interface", "I", 14, 14, None, True), ("method", "Do", 14, 14, "I", True)],
           {("Errorf", "fmt", "M")}, {("fmt", "*"), ("os/exec", "*")}, set()),
    "typescript": ("import { A, B as C } from './x';\nimport D from \"y\";\nexport class C1 extends Base<T> implements I, J {\n  private m(s: string): string { // }\n    if (s) { return f2(`}${s}`); }\n  }\n}\nconst h = (a) => { return f(a); };\ninterface P { q(x: number): void; }\n",
                   [("class", "C1", 3, 7, None, True), ("method", "m", 4, 6, "C1", False), ("function", "h", 8, 8, None, False), ("interface", "P", 9, 9, None, False), ("method", "q", 9, 9, "P", False)],
                   {("f2", None, "m"), ("f", None, "h")}, {("./x", "A"), ("./x", "B"), ("y", "D")}, {("C1", "extends", "Base"), ("C1", "implements", "I"), ("C1", "implements", "J")}),
    "java": ('import java.util.List;\npublic class C<T> extends Base<T> implements I {\n  /* void x() { } */\n  public int m(int a) throws E { String s = "} void y() {"; return f(a) + new C().g(); }\n  abstract void z();\n}\n',
             [("class", "C", 2, 6, None, True), ("method", "m", 4, 4, "C", True), ("method", "z", 5, 5, "C", False)],
             {("f", None, "m"), ("C", None, "m"), ("g", "()", "m")}, {("java.util.List", "*")}, {("C", "extends", "Base"), ("C", "implements", "I")}),
    "rust": ("use std::collections::{HashMap, BTreeMap};\npub struct S<'a> { a: &'a str }\nimpl<'a> Tr for S<'a> { fn m(&self) { let s = r#\"fn x() { \"}\" \"#; f('}') } }\npub fn f<T>(c: char) where T: X { c.len() }\n",
             [("class", "S", 2, 2, None, True), ("method", "m", 3, 3, "S", False), ("function", "f", 4, 4, None, True)],
             {("f", None, "m"), ("len", "c", "f")}, {("std::collections", "HashMap"), ("std::collections", "BTreeMap")}, {("S", "implements", "Tr")}),
    "cpp": ('#include <vector>\nclass C : public B, private D { public: int m(int a) { return f(a); } };\nint C::d() { return "}"[0]; }\nstatic int f(int x) { /* int g() { */ return obj->call(x); }\ntemplate<class T> struct P *make(void) { return 0; }\n',
            [("class", "C", 2, 2, None, True), ("method", "m", 2, 2, "C", True), ("method", "d", 3, 3, "C", True), ("function", "f", 4, 4, None, False), ("function", "make", 5, 5, None, True)],
            {("f", None, "m"), ("call", "obj", "f")}, {("vector", "*")}, {("C", "extends", "B"), ("C", "extends", "D")}),
    "csharp": ('using System.Text;\npublic class C : B, I { public int M(int a) => F(a); public string N() { return @"} class X {""}"; } }\n',
               [("class", "C", 2, 2, None, True), ("method", "M", 2, 2, "C", True), ("method", "N", 2, 2, "C", True)],
               {("F", None, None)}, {("System.Text", "*")}, {("C", "extends", "B"), ("C", "extends", "I")}),
}


@pytest.mark.parametrize("language", sorted(SNIPPETS))
def test_snippets(language):
    text, definitions, calls, imports, bases = SNIPPETS[language]
    f = E.File(text, language)
    assert [tuple(d) for d in f.definitions] == definitions
    assert {(n, r, c) for n, r, _, c in f.calls} == calls
    assert {(s, n) for s, n, _ in f.imports} == imports and {b[:3] for b in f.bases} == bases


@pytest.mark.parametrize("language", sorted(E.LANGUAGES))
def test_broken_text(language):
    """Anything ends, soon, in some result."""
    rng = random.Random(language)
    bits = ["{", "}", "(", ")", "'", '"', "`", "class ", "def ", "fn ", "func ", "a", "\n", "    ", "/*", "*/", "//", "#", "<", ">", "=", "=>", ";", ":", "import ", "from ", "\\", "é"]
    for _ in range(150):
        E.File("".join(rng.choice(bits) for _ in range(60)), language)
    began = time.time()
    for bit in bits:
        E.File(bit * 20_000, language)
    assert time.time() - began < 60 and not E.File("", language).definitions


def test_cache(spark, tmp_path, monkeypatch):
    def files(rows):
        return spark.createDataFrame(rows, "path string, language string, text string")

    def names(rows):
        return {r.file: [d.name for d in r.definitions] for r in rows.collect()}

    first = [("a.py", "python", "def a(): pass"), ("b.py", "python", "def b(): pass"), ("c.py", "python", "def a(): pass"), ("d.md", "markdown", "def d(): pass"), ("e.go", "go", None)]
    cache = ParseCache(spark, str(tmp_path / "cache"))
    rows, n = cache.parse(files(first), budget=10)
    assert n == 3 and names(rows) == {"a.py": ["a"], "b.py": ["b"], "c.py": ["a"], "e.go": []}
    again, n = cache.parse(files(first))
    assert n == 0 and names(again) == names(rows)
    rows, n = cache.parse(files([*first[1:], ("a.py", "python", "def x(): pass\ndef y(): pass")]))
    assert n == 1 and names(rows)["a.py"] == ["x", "y"]
    # a part that was not written to its end counts for nothing
    (tmp_path / "cache" / "part-broken").mkdir()
    assert cache.parse(files(first))[1] == 0
    assert ParseCache(spark, cache.path, version=2).parse(files(first))[1] == 3
    assert cache.parse(files([]))[1] == 0


def test_bad_file_costs_one_row(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a.py", "b.xx", "c.py"]), pa.array(["python", "none", "python"]), pa.array(["def a(): pass", "x", "def c(): pass"])], ["path", "language", "text"])
    out = next(E._parsed(iter([batch]))).to_pylist()
    assert [len(r["definitions"]) for r in out] == [1, 0, 1] and out[1]["error"].startswith("KeyError") and out[0]["error"] is None
