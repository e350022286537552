"""Definitions, calls, imports and bases of source files, by a lexer for each family of languages and a stack of scopes.

The lexer knows strings, comments and line structure, so what stands in them defines and calls nothing. Scopes open at
braces, in Python at indents, and end where these end. One pass over a file's tokens; a file is one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Token(NamedTuple):
    kind: str  # name, op, string, or line (of a Python line's indent)
    text: str
    line: int


# what the languages' lexers skip or take whole; an open one runs to the end of its line or of the file
_QUOTED = r'"(?:[^"\\\n]|\\.)*+"?' + r"|'(?:[^'\\\n]|\\.)*+'?"
_BRACED_COMMENT = r"//[^\n]*+|/\*(?:[^*]|\*(?!/))*+(?:\*/)?"
_SKIPPED = {
    "python": (r"\#[^\n]*+", r"[rbfuRBFU]{0,2}(?:\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*+(?:\"\"\")?|'''(?:[^'\\]|\\.|'(?!''))*+(?:''')?|" + _QUOTED + ")"),
    "javascript": (_BRACED_COMMENT, _QUOTED + r"|`(?:[^`\\]|\\.)*+`?"),
    "go": (_BRACED_COMMENT, _QUOTED + r"|`[^`]*+`?"),
    "rust": (_BRACED_COMMENT, r'b?r(?P<hash>\#*)"(?:[^"]|"(?!(?P=hash)))*+"?(?P=hash)|b?"(?:[^"\\]|\\.)*+"?' + r"|'(?:[^'\\\n]|\\[^\n]{1,9}?)'"),
    "java": (_BRACED_COMMENT, r'"""(?:[^"\\]|\\.|"(?!""))*+(?:""")?|' + _QUOTED),
    "csharp": (_BRACED_COMMENT, r'\$?@\$?"(?:[^"]|"")*+"?|\$?' + r'"(?:[^"\\\n]|\\.)*+"?' + r"|'(?:[^'\\\n]|\\.)*+'?"),
    "c": (_BRACED_COMMENT, r'R"(?P<mark>[^()\s\\]{0,16})\((?:[^)]|\)(?!(?P=mark)"))*+(?:\)(?P=mark)")?|' + _QUOTED),
}
_SKIPPED |= {"typescript": _SKIPPED["javascript"], "tsx": _SKIPPED["javascript"], "cpp": _SKIPPED["c"]}
_LEXERS = {
    lang: re.compile(rf"(?P<comment>{comment})|(?P<string>{string})|(?P<name>[^\W\d][\w$]*+)|(?P<number>\d[\w.]*+)|(?P<line>\n)|(?P<op>::|->|=>|:=|[^\s\w])", re.DOTALL) for lang, (comment, string) in _SKIPPED.items()
}

# fixed values: words before "(" that call nothing
_NO_CALL = frozenset(
    "if for while switch catch return function func fn def class elif match with lambda and or not in is assert del yield await async new throw sizeof typeof delete else do case select go defer using lock foreach when unsafe loop where as super".split()
)
_TYPES = {"class": "class", "struct": "class", "record": "class", "enum": "class", "interface": "interface", "trait": "interface"}
_TYPED = {"javascript": "class", "typescript": "class interface enum", "tsx": "class interface enum", "java": "class interface enum record", "csharp": "class interface enum record struct", "rust": "struct enum trait", "c": "struct enum", "cpp": "class struct enum"}
_JS = ("javascript", "typescript", "tsx")


def tokens(text: str, language: str) -> list[Token]:
    """Tokens without comments; a Python line's first token is its indent."""
    out: list[Token] = []
    line, fresh, depth = 1, True, 0
    python = language == "python"
    for m in _LEXERS[language].finditer(text):
        kind, value = m.lastgroup, m[0]
        if kind in ("hash", "mark"):
            kind = "string"
        if python and fresh and kind not in ("comment", "line"):
            start = text.rfind("\n", 0, m.start()) + 1
            if not depth:
                out.append(Token("line", " " * len(text[start : m.start()].expandtabs(8)), line))
            fresh = False
        if kind == "line":
            fresh = python and not (m.start() and text[m.start() - 1] == "\\")
        elif kind == "string":
            out.append(Token("string", value, line))
        elif kind in ("name", "op"):
            out.append(Token(kind, value, line))
            if python and kind == "op":
                depth = max(0, depth + (value in "([{") - (value in ")]}"))
        line += value.count("\n")
    return out


#: Tokens that the head of a class, a list of type parameters, a receiver or an import's path has at most.
HEAD = 400


class Scope(NamedTuple):
    depth: int  # of braces, or the indent
    at: int  # its definition, -1 for a block
    kind: str
    name: str


class File:
    """What a file's tokens define and use."""

    def __init__(self, text: str, language: str):
        self.language, self.t = language, tokens(text, language)
        self.definitions: list[list] = []  # kind, name, line, end_line, parent, exported
        self.calls: list[tuple] = []  # name, receiver, line, caller
        self.imports: list[tuple] = []  # source, symbol, line
        self.bases: list[tuple] = []  # class, relation, base, line
        self.scopes: list[Scope] = []
        self.closing, self.following = self._matched(), {}
        (self._indented if language == "python" else self._braced)()

    # helpers

    def _is(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.t) and self.t[i].text in texts and self.t[i].kind != "string"

    def _name(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "name"

    def _close(self, i: int) -> int:
        """The place behind the bracket that ends the one at i. Angles must close before a brace or semicolon does."""
        if self.t[i].text != "<":
            return self.closing.get(i, len(self.t))
        depth = 0
        for k in range(i, min(self._next(i, "{", "}", ";"), i + HEAD)):
            if self.t[k].kind == "op":
                depth += (self.t[k].text == "<") - (self.t[k].text == ">")
                if not depth:
                    return k + 1
        return i + 1

    def _next(self, i: int, *texts: str) -> int:
        """The first place from i on of one of these signs, the end without any; looked up for all places at once."""
        if texts not in self.following:
            at, out = len(self.t), [len(self.t)] * (len(self.t) + 1)
            for k in range(len(self.t) - 1, -1, -1):
                at = k if self._is(k, *texts) else at
                out[k] = at
            self.following[texts] = out
        return self.following[texts][min(i, len(self.t))]

    def _matched(self) -> dict[int, int]:
        """The place behind the closing bracket of each opening one that has one."""
        out, opened = {}, []
        for k, t in enumerate(self.t):
            if t.kind == "op" and t.text in "([{":
                opened.append(k)
            elif t.kind == "op" and t.text in ")]}" and opened:
                out[opened.pop()] = k + 1
        return out

    def _parent(self) -> str | None:
        return next((s.name for s in reversed(self.scopes) if s.kind in ("class", "interface")), None)

    def _caller(self) -> str | None:
        return next((s.name for s in reversed(self.scopes) if s.kind == "function"), None)

    def _define(self, kind: str, name: str, i: int, exported: bool, parent: str | None = None) -> int:
        self.definitions.append([kind, name, self.t[i].line, self.t[i].line, parent or self._parent(), exported])
        return len(self.definitions) - 1

    def _call(self, i: int) -> None:
        """A name before a bracket calls it; its receiver is the dotted name before."""
        if not self._is(i + 1, "(") or self.t[i].text in _NO_CALL:
            return
        k, parts = i, []
        while self._is(k - 1, ".", "::", "->") and (self._name(k - 2) or self._is(k - 2, ")", "]")):
            if not self._name(k - 2):
                parts.append("()")
                break
            parts.append(self.t[k - 2].text)
            k -= 2
        self.calls.append((self.t[i].text, ".".join(reversed(parts)) or None, self.t[i].line, self._caller()))

    def _names(self, i: int, to: int) -> list[str]:
        """Dotted names of a list at commas."""
        out, k = [], i
        while k < to:
            if self._name(k):
                name = self.t[k].text
                while self._is(k + 1, ".", "::") and self._name(k + 2):
                    name, k = f"{name}.{self.t[k + 2].text}", k + 2
                out.append(name)
                if name in ("public", "private", "protected", "virtual"):
                    k += 1
                    continue
                while k < to and not self._is(k, ","):  # what follows a name up to the comma
                    k = self._close(k) if self._is(k, "(", "[", "<", "{") else k + 1
            k += 1
        return out

    # Python

    def _indented(self) -> None:
        last, i = 0, 0
        while i < len(self.t):
            tok = self.t[i]
            if tok.kind == "line":
                indent = len(tok.text)
                self._dedent(indent, last)
                i = self._statement(i + 1, indent)
                continue
            if tok.kind == "name":
                self._call(i)
            last = tok.line + tok.text.count("\n")
            i += 1
        self._dedent(0, last)

    def _dedent(self, indent: int, last: int) -> None:
        while self.scopes and indent <= self.scopes[-1].depth:
            self.definitions[self.scopes.pop().at][3] = last

    def _statement(self, i: int, indent: int) -> int:
        at = i + 1 if self._is(i, "async") else i
        if self._is(at, "def", "class") and self._name(at + 1):
            kind, name = ("class" if self.t[at].text == "class" else "function"), self.t[at + 1].text
            inside = self.scopes and self.scopes[-1].kind == "class"
            made = self._define("method" if kind == "function" and inside else kind, name, at, not name.startswith("_"), self.scopes[-1].name if inside else None)
            if not inside:
                self.definitions[made][4] = None
            end = self._close(at + 2) if self._is(at + 2, "(") else at + 2
            if kind == "class" and end > at + 3:
                self.bases += [(name, "extends", b, self.t[at].line) for b in self._names(at + 3, end - 1) if b != "metaclass"]
            self.scopes.append(Scope(indent, made, kind, name))
            return at + 2
        if self._is(i, "from"):
            stop = next((k for k in range(i, len(self.t)) if self.t[k].kind == "line"), len(self.t))  # the statement's end: read once
            end = next((k for k in range(i, stop) if self._is(k, "import")), stop)
            if self._is(end, "import"):
                named = self._names(end + 1, stop) or ["*"]
                self.imports += [("".join(x.text for x in self.t[i + 1 : end]), s, self.t[i].line) for s in named]
                return stop
        if self._is(i, "import"):
            stop = next((k for k in range(i, len(self.t)) if self.t[k].kind == "line"), len(self.t))
            self.imports += [(s, "*", self.t[i].line) for s in self._names(i + 1, stop)]
            return stop
        return i

    # braces

    def _braced(self) -> None:
        depth, i, waiting = 0, 0, None  # waiting: a scope whose brace is to come
        while i < len(self.t):
            tok = self.t[i]
            if tok.kind == "op":
                if tok.text == "{":
                    depth += 1
                    self.scopes.append(waiting._replace(depth=depth) if waiting else Scope(depth, -1, "block", ""))
                    waiting = None
                elif tok.text == "}":
                    if self.scopes:
                        done = self.scopes.pop()
                        if done.at >= 0:
                            self.definitions[done.at][3] = tok.line
                    depth = max(0, depth - 1)
                elif tok.text == ";":
                    waiting = None
            elif tok.kind == "name" and not self._is(i - 1, ".", "->"):
                found = self._definition(i)
                if found:
                    waiting, i = found
                    continue
                i = self._import(i)
                if i < len(self.t) and self.t[i] is tok:
                    self._call(i)
            elif tok.kind == "name":
                self._call(i)
            i += 1
        last = self.t[-1].line if self.t else 1
        for s in self.scopes:
            if s.at >= 0:
                self.definitions[s.at][3] = last

    def _exported(self, i: int, name: str) -> bool:
        if self.language == "go":
            return name[:1].isupper()
        words, k = set(), i - 1
        while self._name(k) or self._is(k, ")", "(", "<", ">", "[", "]", "*", "&", ",", "?", "@"):
            words.add(self.t[k].text)
            k -= 1
            if i - k > 12:
                break
        return {"rust": "pub", "java": "public", "csharp": "public"}.get(self.language, "export") in words if self.language not in ("c", "cpp") else "static" not in words

    def _definition(self, i: int) -> tuple[Scope | None, int] | None:
        """The scope that a definition here opens and the place behind its head; None if there is none."""
        lang, word = self.language, self.t[i].text
        inside = self.scopes[-1].kind in ("class", "interface") if self.scopes else False
        if word in _TYPED.get(lang, "").split() and self._name(i + 1) and not self._is(i - 1, "enum"):
            name, kind = self.t[i + 1].text, _TYPES[word]
            k = self._close(i + 2) if self._is(i + 2, "<") else i + 2
            stop = self._next(k, "{", ";", "(")
            if lang in ("c", "cpp"):
                k += self._is(k, "final")
                if not (self._is(k, "{") or (self._is(k, ":") and self._is(stop, "{"))):
                    return None
            made = self._define(kind, name, i, self._exported(i, name))
            self._heritage(name, k, min(stop, k + HEAD), i)
            return Scope(0, made, kind, name), k if lang == "rust" or not self._is(stop, "{") else stop
        if lang == "go" and word == "type" and self._name(i + 1) and self._is(i + 2, "struct", "interface"):
            kind = _TYPES[self.t[i + 2].text]
            return Scope(0, self._define(kind, self.t[i + 1].text, i, self.t[i + 1].text[:1].isupper()), kind, self.t[i + 1].text), i + 3
        if lang == "rust" and word == "impl":
            k = self._close(i + 1) if self._is(i + 1, "<") else i + 1
            stop = self._next(k, "{", ";")
            cut = self._next(k, "for")
            cut = cut if cut < stop else 0
            of = self._names(cut + 1 if cut else k, min(stop, k + 200))[:1]
            if of and cut:
                self.bases += [(of[0], "implements", b, self.t[i].line) for b in self._names(k, cut)[:1]]
            return Scope(0, -1, "class", of[0] if of else ""), stop
        if word in ("func", "fn", "function") and lang in ("go", "rust", *_JS):
            k, parent = i + 1 + self._is(i + 1, "*"), None
            if lang == "go" and self._is(k, "("):
                end = self._close(k)
                named = [x.text for x in self.t[k : min(end, k + HEAD)] if x.kind == "name"]
                parent, k = (named[1] if len(named) > 1 else named[0] if named else None), end
            if not self._name(k):
                return None
            name = self.t[k].text
            owner = self.scopes[-1].name if inside else None
            made = self._define("method" if parent or owner else "function", name, i, self._exported(i, name), parent or owner)
            return Scope(0, made, "function", name), self._head(k + 1)
        if lang in _JS and word in ("const", "let", "var") and self._name(i + 1):
            k = next((x for x in range(i + 2, min(i + 12, len(self.t))) if self._is(x, "=", ";", "{")), -1)
            if k > 0 and self._is(k, "="):
                k += 1 + self._is(k + 1, "async")
                arrow = self._close(k) if self._is(k, "(") else k + 1 if self._name(k) else 0
                if self._is(arrow, ":"):
                    arrow = self._next(arrow, "=>", ";", "=", "{")
                if self._is(k, "function") or (arrow and self._is(arrow, "=>")):
                    made = self._define("function", self.t[i + 1].text, i, self._exported(i, ""))
                    return Scope(0, made, "function", self.t[i + 1].text), (self._head(k + 1) if self._is(k, "function") else arrow + 1)
        if lang == "go" and inside and self.scopes[-1].kind == "interface" and self._is(i + 1, "(") and (self.t[i - 1].line < self.t[i].line or self._is(i - 1, "{", ";")):
            self._define("method", word, i, word[:1].isupper(), self.scopes[-1].name)
            return None, self._close(i + 1)
        typed_call = inside and lang in (*_JS, "java", "csharp") and self._is(i + 1, "<") and self._is(self._close(i + 1), "(")
        if (self._is(i + 1, "(") or typed_call) and word not in _NO_CALL and not self._is(i - 1, "new", "return", "=", "=>", "(", ",", "!", "&&", "+", "-"):
            typed = lang in ("java", "csharp", "c", "cpp")
            if (inside and lang != "rust" and lang != "go") or (lang in ("c", "cpp") and not any(s.kind == "function" for s in self.scopes) and (self._name(i - 1) or self._is(i - 1, "*", "&", ">", "::"))):
                end = self._head(i + 1)
                declared = (self._is(end, ";") or (lang == "csharp" and self._is(end, "=>"))) and self.scopes and (self.scopes[-1].kind == "interface" or (typed and inside and (self._name(i - 1) or self._is(i - 1, ">", "]"))))
                if self._is(end, "{") or declared:
                    owner = self.t[i - 2].text if lang == "cpp" and self._is(i - 1, "::") and self._name(i - 2) else self.scopes[-1].name if inside else None
                    made = self._define("method" if owner else "function", word, i, self._exported(i, word), owner)
                    return (Scope(0, made, "function", word) if self._is(end, "{") else None), end
        return None

    def _head(self, i: int) -> int:
        """Behind type parameters and parameters at i: the brace or ";" that the head ends in, or the place there."""
        k = self._close(i) if self._is(i, "<") else i
        if not self._is(k, "("):
            return k
        k = self._close(k)
        for x in range(k, min(k + 60, len(self.t))):  # result types and clauses
            if self._is(x, "{", ";", "}"):
                return x
            if self._is(x, "=", "=>") or (self._is(x, ",") and self.language in ("c", "cpp")):
                return k
        return k

    def _heritage(self, name: str, i: int, stop: int, at: int) -> None:
        line, relation, k = self.t[at].line, None, i
        marks = [x for x in range(i, stop) if self._is(x, "extends", "implements") or (self._is(x, ":") and self.language in ("csharp", "cpp", "rust"))]
        for n, x in enumerate(marks):
            relation = "implements" if self.t[x].text == "implements" else "extends"
            end = marks[n + 1] if n + 1 < len(marks) else stop
            k = x + 1
            self.bases += [(name, relation, b, line) for b in self._names(k, end) if b not in ("public", "private", "protected", "virtual")]

    def _string(self, i: int) -> int:
        """The first string from i on."""
        if "string" not in self.following:
            at, out = len(self.t), [len(self.t)] * (len(self.t) + 1)
            for k in range(len(self.t) - 1, -1, -1):
                at = k if self.t[k].kind == "string" else at
                out[k] = at
            self.following["string"] = out
        return self.following["string"][min(i, len(self.t))]

    def _import(self, i: int) -> int:
        lang, word, line = self.language, self.t[i].text, self.t[i].line
        if word not in ("import", "using", "use", "include"):
            return i
        stop = self._next(i, ";")
        if lang == "go" and not self._is(i + 1, "("):
            stop = next((x for x in range(i, min(i + 4, len(self.t))) if self.t[x].line > line), min(i + 4, len(self.t)))
        if lang in _JS and word == "import" and not self._is(i + 1, "(", "."):
            end = self._string(i)
            if end < stop:
                names = [s for s in self._names(i + 1, end) if s not in ("from", "type")]
                brace = self._next(i, "{")
                brace = brace if brace < end else None
                named = self._names(brace + 1, self._close(brace) - 1) if brace else names[:1] if names and not self._is(i + 1, "*") else []
                self.imports += [(self.t[end].text.strip("\"'`"), s, line) for s in named or ["*"]]
                return end
        elif lang == "go" and word == "import":
            end = self._close(i + 1) if self._is(i + 1, "(") else stop
            self.imports += [(x.text.strip('"`'), "*", x.line) for x in self.t[i:end] if x.kind == "string"]
            return end - 1
        elif lang in ("java", "csharp", "rust") and word in ("import", "using", "use") and not self._is(i + 1, "(", "var"):
            brace = self._next(i, "{")
            brace = brace if brace < stop else None
            source = "".join(x.text for x in self.t[i + 1 : min(brace or stop, i + HEAD)] if x.text != "static").rstrip(":")
            named = self._names(brace + 1, self._close(brace) - 1) if brace else ["*"]
            if "=" not in source:
                self.imports += [(source, s, line) for s in named]
                return stop
        elif lang in ("c", "cpp") and word == "include" and self._is(i - 1, "#"):
            end = next((x for x in range(i, min(i + 40, len(self.t))) if self.t[x].line > line), min(i + 40, len(self.t)))
            self.imports.append(("".join(x.text for x in self.t[i + 1 : end]).strip('"<>'), "*", line))
            return end - 1
        return i


DEFINITIONS = "kind string, name string, line int, end_line int, parent string, exported boolean"
CALLS = "name string, receiver string, line int, caller string"
IMPORTS = "source string, symbol string, line int"
BASES = "class string, relation string, base string, line int"
PARSED = f"file string, definitions array<struct<{DEFINITIONS.replace(' ', ':').replace(',:', ',')}>>, calls array<struct<{CALLS.replace(' ', ':').replace(',:', ',')}>>, imports array<struct<{IMPORTS.replace(' ', ':').replace(',:', ',')}>>, bases array<struct<{BASES.replace(' ', ':').replace(',:', ',')}>>, error string"
_KINDS = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}


def _struct(spec: str) -> pa.DataType:
    return pa.list_(pa.struct([(n, _KINDS[t]) for n, t in (f.split() for f in spec.split(", "))]))


LANGUAGES = frozenset(_LEXERS)


#: Bytes of source text, some, whose results a task hands on at once.
PIECE = 1 << 20


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        size = 0
        for path, language, text in zip(*batch.columns, strict=True):
            path, language, text = path.as_py(), language.as_py(), text.as_py() or ""
            try:
                f = File(text, language)
                rows.append((path, f.definitions, f.calls, f.imports, f.bases, None, language))
            except Exception as e:  # one bad file costs one row
                rows.append((path, [], [], [], [], f"{type(e).__name__}: {e}", language))
            size += len(text)
            if size >= PIECE:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    specs = (DEFINITIONS, CALLS, IMPORTS, BASES)
    made = [pa.array([[dict(zip((x.split()[0] for x in s.split(", ")), r, strict=True)) for r in row] for row in c], _struct(s)) for s, c in zip(specs, cols[1:5], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *made, pa.array(cols[5], pa.string()), pa.array(cols[6], pa.string())], ["file", "definitions", "calls", "imports", "bases", "error", "language"])


def parsed(files: DataFrame, also: list[str] | None = None) -> DataFrame:
    """PARSED rows of files(path, language, text): what each defines, calls, imports and extends; an error instead, where it can't be read.

    Files of a language that has no lexer are left out; null texts are empty. Lines count from 1; a method's parent is its class.
    """
    out = files.filter(F.col("language").isin(sorted(LANGUAGES))).select("path", "language", "text").mapInArrow(_parsed, f"{PARSED}, language string")
    return out.select("file", "definitions", "calls", "imports", "bases", "error", *(also or []))


def unnested(rows: DataFrame, part: str) -> DataFrame:
    """(file, ...) of one of definitions, calls, imports and bases."""
    return rows.select("file", F.inline(part))
