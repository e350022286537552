"""A lexer of source and configuration syntax that yields what is assigned to which names.

States are those of the syntaxes themselves: default, value (after an assignment), quoted strings of all kinds,
here-documents, block scalars, tags and comments. Comments and strings that hold assignments are lexed as regions of
their own, whose names are not those of the code around them. Braces and indented definitions open scopes; a name
stands for its last value before, or else its first one after, in the innermost scope that has one.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field

_TOKENS = r"""
      (?P<line>\n)
    | (?P<define>\#[\x20\t]*define[\x20\t]+(?P<dname>[A-Za-z_]\w*)[\x20\t]+)
    | (?P<comment>%s)
    | (?P<string>(?<!\w)(?:[rbfuRBFU]{1,2})?(?:\"\"\"(?:[^"\\]|\\.|"(?!""))*+\"\"\" | '''(?:[^'\\]|\\.|'(?!''))*+''' | '(?:[^'\\\n]|\\.)*+' | "(?:[^"\\\n]|\\.)*+")
        | "(?:[^"\\\n]|\\.)*+" | `(?:[^`\\]|\\.)*+`)
    | (?P<heredoc><<[-~]?\x20?(?P<hq>["']?)(?P<hname>[A-Za-z_]\w*+)(?P=hq))
    | (?P<tag><(?P<tname>[A-Za-z_][\w.:-]*+)(?=[\s/>])(?P<attrs>[^<>]*+)>)
    | (?P<option>(?<!\S)--(?P<oname>[A-Za-z][\w-]*+)[\x20\t]++(?=[\w$"']))
    | (?P<name>[^\W\d][\w$]*+(?:[.-][\w$]++)*+)
    | (?P<op>::|:/|:=|=>|=~|={2,3}|!=|<=|>=|\+=|\|\||\.\.|->|[=:+.,&(){}\[\]])
    | (?P<other>\\. | \w++ | [^\s\w"'`<\#/:=+.,&(){}\[\]|>!\\-]++ | .)
    """
_COMMENT = r"""(?<!\S)\#[^\n]*+ | (?<!:)//[^\n]*+ | /\*(?:[^*]|\*(?!/))*+(?:\*/)? | <!--(?:[^-]|-(?!->))*+(?:-->)? | (?<!\S)--\x20[^\n]*+"""
_TOKEN = re.compile(_TOKENS.replace("%s", _COMMENT), re.VERBOSE | re.DOTALL)
#: Inside a comment a further sign is skipped, and what follows it is lexed in place: each character is read once.
_TOKEN_IN_COMMENT = re.compile(_TOKENS.replace("%s", r"(?<!\S)\#++ | (?<!:)//++ | /\*++ | <!--+ | (?<!\S)--\x20"), re.VERBOSE | re.DOTALL)
_KINDS = ("name", "other", "op", "line", "string", "comment", "tag", "option", "define", "heredoc")
_GAP = re.compile(r"(?:[\x20\t\r]|\\\r?\n)++")
_NAME = r"[^\W\d][\w$]*+(?:[.-][\w$]++)*+"
#: Another target where a value is due: `A = B = ...`, `name: type = ...`, `key: name=value`.
_CHAIN = re.compile(rf"""({_NAME})["'\]?]{{0,2}}[\x20\t]*+(?::=|=>|=(?![=~]))[\x20\t]*+(?=[\w$"'`(])""")
#: Unquoted values; = is padding there, unless a quoted value follows it.
_BARE = re.compile(r"""[\w$](?:[\w+/.$@!%^*~#?-]|=(?!["']))*+""")
_STRING = re.compile(r"""[rbfuRBFU]{0,2}(\"\"\"|'''|["'`])""")
_BLOCK = re.compile(r"[|>][+-]?[0-9]?[+-]?[\x20\t]*(?:\#[^\n]*)?\n")
_NEXT_LINE = re.compile(r"""\r?\n([\x20\t]++)(?:"([^"\n]*+)"|'([^'\n]*+)'|([\w$][\w+/.=$!@#%^*~-]*+))[\x20\t\r]*+(?=\n|\Z)""")
_ATTR = re.compile(r"""(?<![\w.:-])([A-Za-z_][\w.:-]*+)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)')""")
_OPENED, _HELD = re.compile(r"\s*+(?:<!\[CDATA\[)?\s*+"), re.compile(r"[^<\]]*+")
_CLOSED = re.compile(r"(?:\]\]>)?\s*+</([A-Za-z_][\w.:-]*+)\s*+>")
_WORDLIKE = re.compile(r"[\w.-]+")
#: What follows a sign on the same line if it joins strings.
_JOINED = re.compile(r"""[\x20\t]*+["'`$]""")
_COMMA = re.compile(r"[\x20\t]*+,[\x20\t]*+")
_JOINS_NEXT = re.compile(r"""\s*+(?:\+|\.(?=\s*["'])|&(?=\s*["'])|\|\|)""")
_LINE = re.compile(r"\S(?:[^\n]*\S)?")
_ASSIGN = {"=", ":=", "=>", ":", "+="}
_JOIN = {"+", ".", "..", "&", "||"}
_SETTERS = re.compile(r"(?:.*\.)?(?:set|with|put|add|use)(?=[A-Z_])")
_DEFINES = {"def", "class", "fn", "func", "function"}


@dataclass
class Assigned:
    """names take the value that `parts` make when joined."""

    names: list[str]
    #: Literals as spans, and the numbers of assignments whose values come in, in order.
    parts: list[tuple[int, int] | int] = field(default_factory=list)
    #: Unquoted operands, which may be values or names, and whether letters alone can be a value there.
    bare: list[tuple[int, int, bool]] = field(default_factory=list)
    #: Operands as read (text of an unquoted one or None, start, end), and the scope.
    read: list[tuple[str | None, int, int]] = field(default_factory=list)
    scope: int = 0


class Lexer:
    """Reads a text once; `found` has its assignments in order, region by region.

    `inner` says of a comment's or string's text whether it is to be lexed as a region of its own.
    """

    def __init__(self, text: str, inner):
        self.text, self.inner = text, inner
        self.found: list[Assigned] = []
        self.parent: list[int] = []
        self.missing: dict[str, int] = {}
        self.line = (0, -1)  # a place, and the first line end from it on
        regions = [(0, len(text), False)]
        while regions:
            self._region(*regions.pop(), regions)
        self._resolve()

    def _scope(self, parent: int) -> int:
        self.parent.append(parent)
        return len(self.parent) - 1

    def _region(self, a: int, b: int, comment: bool, regions: list[tuple[int, int, bool]]) -> None:
        text, at, token = self.text, a, _TOKEN_IN_COMMENT if comment else _TOKEN
        self.token = token
        root = scope = self._scope(-1)
        blocks: list[tuple[int, int]] = []  # (indent, scope) of open definitions
        opened: list[int] = []  # scopes to go back to at closing braces
        indent, fresh, opens, words = 0, True, -1, 0
        target: str | None = None  # the name or key that an assignment would be to
        before = ""  # the operator before it
        callee = ""
        while at < b:
            gap = _GAP.match(text, at, b)
            if gap:
                if fresh:
                    indent = gap.end() - at
                at = gap.end()
                if at >= b:
                    break
            m = token.match(text, at, b)
            at = m.end()
            kind = next(k for k in _KINDS if m[k] is not None)
            if kind == "line":
                indent, fresh, target, words = 0, True, None, 0
                continue
            words += kind in ("name", "string")
            if fresh and kind != "comment":
                while blocks and indent <= blocks[-1][0]:
                    scope = blocks.pop()[1]
                if opens >= 0:
                    if indent > opens:
                        blocks.append((opens, scope))
                        scope = self._scope(scope)
                    opens = -1
                if kind == "name" and m[0] in _DEFINES:
                    opens = indent
                fresh = False
            if kind == "comment":
                if not comment:
                    self._nested(m.start() + 1, m.end(), regions, comment=True)
            elif kind == "string":
                start, end = self._content(m.start(), m.end())
                if before == "(" and end - start < 80 and _WORDLIKE.fullmatch(text, start, end) and (comma := _COMMA.match(text, at, b)):
                    at = self._value([text[start:end]], comma.end(), b, scope, regions)
                    before = callee = ""
                    continue
                if before == "(" and _SETTERS.match(callee):
                    at = self._value([callee], m.start(), b, scope, regions)
                    before = callee = ""
                    continue
                target = text[start:end] if end - start < 200 and _WORDLIKE.fullmatch(text, start, end) else None
                self._nested(start, end, regions)
            elif kind == "heredoc":
                at = self._heredoc(m, b, None, regions)[1]
                fresh = True
            elif kind == "tag":
                self._tag(m, b, scope)
            elif kind == "define":
                at = self._value([m["dname"]], at, b, scope, regions)
            elif kind == "option":
                at = self._value([m["oname"]], at, b, scope, regions)
            elif kind == "name":
                target = m[0]
            elif kind == "op":
                op = m[0]
                if op in _ASSIGN and target is not None:
                    if op == ":" and words == 1 and (block := self._block(at, b, indent)):
                        self.found.append(Assigned([target], read=[(None, *s) for s in block[0]], scope=scope))
                        at, fresh, words = block[1], True, 0
                    else:
                        at = self._value([target], at, b, scope, regions)
                    target = None
                elif op == "{":
                    opened.append(scope)
                    scope = self._scope(scope)
                elif op == "}":
                    scope = opened.pop() if opened else root
                if op == "(":
                    callee = target or ""
                if op not in ("]", "."):
                    target = None
            else:
                target = target if m[0] in ("?", "!") else None
            before = m[0] if kind == "op" else ""

    def _nested(self, a: int, b: int, regions: list[tuple[int, int, bool]], comment: bool = False) -> None:
        if b - a > 8 and self.inner(self.text, a, b):
            regions.append((a, b, comment))

    def _content(self, a: int, b: int) -> tuple[int, int]:
        """The span inside a string's quotes."""
        quote = _STRING.match(self.text, a, b)
        n = len(quote[1])
        return quote.end(), b - n

    def _heredoc(self, m: re.Match, b: int, names: list[str] | None, regions: list[tuple[int, int, bool]]) -> tuple[list[tuple[int, int]], int]:
        """Spans of the lines of a here-document, and its end; without a last line it is no document."""
        name, start = m["hname"], self._next_line(m.end(), b)
        if start < 0 or self.missing.get(name, b + 1) <= start:
            return [], m.start() + 2
        end = re.compile(rf"^[\x20\t]*{re.escape(name)}\b", re.MULTILINE).search(self.text, start, b)
        if not end:
            self.missing[name] = min(start, self.missing.get(name, start))
            return [], m.start() + 2
        if names is None:
            self._nested(start, end.start(), regions)
        return self._lines(start, end.start()), end.end()

    def _next_line(self, at: int, b: int) -> int:
        """Where the next line starts; -1 without one before b."""
        if not self.line[0] <= at <= self.line[1]:
            end = self.text.find("\n", at)
            self.line = (at, len(self.text) if end < 0 else end)
        return self.line[1] + 1 if self.line[1] < b else -1

    def _lines(self, a: int, b: int) -> list[tuple[int, int]]:
        return [(x.start(), x.end()) for x in _LINE.finditer(self.text, a, b)]

    def _block(self, at: int, b: int, indent: int) -> tuple[list[tuple[int, int]], int] | None:
        """The lines of a block scalar, or a scalar on a line of its own, that is indented more than its key; and the end."""
        gap = _GAP.match(self.text, at, b)
        at = gap.end() if gap else at
        head = _BLOCK.match(self.text, at, b)
        if not head:
            own = _NEXT_LINE.match(self.text, at, b)
            if own and len(own[1]) > indent:
                k = next(k for k in (2, 3, 4) if own[k] is not None)
                return [own.span(k)], own.end()
            return None
        start = at = head.end()
        while at < b:
            end = self.text.find("\n", at, b)
            end = b if end < 0 else end
            line = self.text[at:end]
            if line.strip() and len(line) - len(line.lstrip()) <= indent:
                break
            at = end + 1
        return self._lines(start, min(at, b)), min(at, b)

    def _tag(self, m: re.Match, b: int, scope: int) -> None:
        attrs = [(x[1], x.span(2) if x[2] is not None else x.span(3)) for x in _ATTR.finditer(self.text, m.start("attrs"), m.end("attrs"))]
        named = {k.lower(): s for k, s in attrs}
        for k, s in attrs:
            self.found.append(Assigned([k], read=[(None, *s)], scope=scope))
        value = named.get("value")
        for k in ("name", "key", "id"):
            if k in named:
                name = self.text[slice(*named[k])]
                if value:
                    self.found.append(Assigned([name], read=[(None, *value)], scope=scope))
                else:
                    self._tagged(m, b, name, scope)
        self._tagged(m, b, m["tname"], scope)

    def _tagged(self, m: re.Match, b: int, name: str, scope: int) -> None:
        held = _HELD.match(self.text, _OPENED.match(self.text, m.end(), b).end(), b)
        closed = _CLOSED.match(self.text, held.end(), b)
        if closed and closed[1] == m["tname"] and (inner := held[0].rstrip()):
            self.found.append(Assigned([name], read=[(None, held.start(), held.start() + len(inner))], scope=scope))

    def _value(self, names: list[str], at: int, b: int, scope: int, regions: list[tuple[int, int, bool]]) -> int:
        """Read a value: operands that are joined by an operator or, if quoted, by standing side by side; the place after it."""
        text, read, depth, after = self.text, [], 0, "start"
        end = at
        while at < b:
            gap = _GAP.match(text, at, b)
            at = gap.end() if gap else at
            if at >= b:
                break
            if after == "start" and (chain := _CHAIN.match(text, at, b)):
                names.append(chain[1])
                at = chain.end()
                continue
            m = self.token.match(text, at, b)
            if m["line"] is not None:
                # inside parentheses, after an operator and before one, a line's end is a gap
                if not depth and after != "join" and not (after != "start" and _JOINS_NEXT.match(text, at, b)):
                    break
                at += 1
            elif m["comment"] is not None and (depth or after == "join"):
                at = m.end()
            elif m["string"] is not None and after in ("start", "join", "string"):
                start, stop = self._content(m.start(), m.end())
                read.append((None, start, stop))
                self._nested(start, stop, regions)
                at = end = m.end()
                after = "string"
            elif m["heredoc"] is not None and after in ("start", "join"):
                lines, at = self._heredoc(m, b, names, regions)
                read += [(None, *s) for s in lines]
                end = at
                break
            elif m["op"] == "(" and after in ("start", "join"):
                depth += 1
                at = m.end()
            elif m["op"] == ")" and depth and read:
                depth -= 1
                at = end = m.end()
            elif m["op"] in _JOIN and after in ("string", "bare") and (m["op"] == "+" or _JOINED.match(text, m.end(), b)):
                at = m.end()
                after = "join"
            elif after in ("start", "join") and (bare := _BARE.match(text, at, b)):
                value = bare[0]
                # a sum of names without gaps
                if "+" in value and text[bare.end() : bare.end() + 1] in ('"', "'"):
                    bare = _BARE.match(text, at, at + value.index("+"))
                read.append((bare[0], *bare.span()))
                at = end = bare.end()
                after = "bare"
            else:
                break
        if read:
            self.found.append(Assigned(names, read=read, scope=scope))
        return max(end, at if not read else end)

    def _resolve(self) -> None:
        """Turn unquoted operands into the assignments that they name."""
        defined: dict[tuple[int, str], list[int]] = {}
        named: dict[int, set[str]] = {}
        asked: dict[int, list[tuple[int, str]]] = {}
        for i, one in enumerate(self.found):
            for name in {n for full in one.names for n in (full, full.rpartition(".")[2])}:
                defined.setdefault((one.scope, name), []).append(i)
                named.setdefault(one.scope, set()).add(name)
            for raw, _, _ in one.read:
                if raw is not None:
                    asked.setdefault(one.scope, []).append((i, raw))
        places = self._places(defined, named, asked)
        for i, one in enumerate(self.found):
            for raw, start, end in one.read:
                if raw is None:
                    one.parts.append((start, end))
                    continue
                place = places.get((i, raw))
                if place is not None:
                    one.parts.append(place)
                elif len(one.read) == 1:
                    one.parts.append((start, end))
                alone = len(one.read) == 1 and self.text[end : end + 1] not in ("(", "[", "{", ".")
                one.bare.append((start, end, alone))

    def _places(self, defined: dict[tuple[int, str], list[int]], named: dict[int, set[str]], asked: dict[int, list[tuple[int, str]]]) -> dict[tuple[int, str], int]:
        """The assignment that each (number, name) means, by one walk over the scopes that keeps each name's open ones.

        A scope fails a name only if its one assignment of it is the asking one, so two scopes at most are looked at.
        """
        below: list[list[int]] = [[] for _ in self.parent]
        for s, p in enumerate(self.parent):
            if p >= 0:
                below[p].append(s)
        out: dict[tuple[int, str], int] = {}
        opened: dict[str, list[int]] = {}
        walk = [(s, True) for s, p in enumerate(self.parent) if p < 0]
        while walk:
            scope, enter = walk.pop()
            if not enter:
                for name in named.get(scope, ()):
                    opened[name].pop()
                continue
            for name in named.get(scope, ()):
                opened.setdefault(name, []).append(scope)
            for i, name in asked.get(scope, ()):
                for near in reversed(opened.get(name, [])[-2:]):
                    there = defined[near, name]
                    k = bisect_left(there, i)
                    later = k + 1 if k < len(there) and there[k] == i else k
                    if k or later < len(there):
                        out[i, name] = there[k - 1] if k else there[later]
                        break
            walk.append((scope, False))
            walk += [(s, True) for s in below[scope]]
        return out
