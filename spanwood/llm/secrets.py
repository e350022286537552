"""Secret scans: fixed base patterns, and a lexer of assignments that follows constants to sensitive names."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .assignments import Assigned, Lexer
from .common import blank, tidy

# Fixed patterns. Letters of names match in either case, ASCII only.
_NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in n) for n in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
#: Least lengths of group 2, and of the matches.
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "pair")

#: What a name's parts say about its value, and what takes a name's weight away.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "bearer": 0.8, "auth": 0.6, "authorization": 0.7, "signature": 0.5, "private": 0.5, "access": 0.4, "key": 0.5, "api": 0.3, "salt": 0.5,
}
HARMLESS = {"public", "count", "max", "min", "length", "limit", "type", "url", "uri", "path", "file", "field", "label", "example", "id", "expires", "ttl", "name"}
PLACEHOLDER = re.compile(r"(?i)^(?:changeme|example|placeholder|your|none|null|true|false|test|dummy|redacted|x{4,}|\*{3,}|<.*>|\$\{.*\}|%.*%)")
#: Literals of this score or more are secrets.
THRESHOLD = 0.5

_PART = re.compile("[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_AROUND = re.compile(r"[\w.$-]+")
_SIGNS = re.compile("[=:<(,|]|--|define")
#: Words of sentences: literals that hold one are messages, not phrases to log in with.
SENTENCE = {
    "a", "an", "and", "are", "at", "be", "by", "can", "cannot", "do", "enter", "for", "from", "has", "have", "in", "incorrect", "invalid", "is", "it", "least", "missing", "must",
    "new", "no", "not", "of", "on", "or", "please", "required", "should", "that", "the", "this", "to", "was", "were", "will", "with", "wrong", "you", "your",
}
_PHRASE = re.compile(r"[\w'-]+(?: [\w'-]+){2,}")
#: Characters of a value that are looked at for placeholders.
HEAD = 64


def _name_score(name: str) -> float:
    parts = [p.lower() for p in _PART.findall(name)]
    if not parts:
        return 0.0
    score = sum(sorted((SENSITIVE.get(p, 0.0) for p in parts), reverse=True)[:2])
    return 0.0 if HARMLESS & set(parts) else min(1.0, score)


@dataclass
class _Value:
    """What scoring needs of a value of any length: its first characters, shares and number of characters, and signs of prose."""

    head: str = ""
    n: float = 0.0
    shares: dict[str, float] = field(default_factory=dict)
    prose: bool = False

    @classmethod
    def of(cls, text: str) -> _Value:
        n = len(text)
        # with spaces, three words or more that make no sentence are a phrase; all else is prose
        prose = any(c.isspace() for c in text) and (not _PHRASE.fullmatch(text) or bool(SENTENCE & set(text.lower().split())))
        return cls(text[:HEAD], float(n), {c: k / n for c, k in Counter(text).items()}, prose)

    def add(self, other: _Value) -> None:
        self.head = (self.head + other.head)[:HEAD]
        # lengths of chains of constants can double from one to the next
        own, more = min(self.n, 1e200), min(other.n, 1e200)
        self.n = own + more
        if self.n:
            self.shares = {c: (self.shares.get(c, 0.0) * own + other.shares.get(c, 0.0) * more) / self.n for c in self.shares.keys() | other.shares.keys()}
        self.prose |= other.prose

    def score(self, plain: float) -> float:
        """plain: the most that a value without both letters and digits gets."""
        if self.n < 8 or self.prose or PLACEHOLDER.match(self.head):
            return 0.0
        bits = -sum(x * math.log2(x) for x in self.shares.values() if x > 0)
        mixed = any(c.isdigit() for c in self.shares) and any(c.isalpha() for c in self.shares) and " " not in self.shares
        return min(1.0, bits / 3.0) * (1.0 if mixed else plain)

    def passes(self, weight: float, plain: bool = True) -> bool:
        return weight * self.score(0.6 if plain and weight >= 1 else 0.45) >= THRESHOLD


def _promising(text: str, start: int = 0, end: int | None = None) -> bool:
    """Whether a name of some weight and a sign of an assignment are in the text: without these, no value can pass."""
    part = text if end is None else text[start:end]
    low = part.lower()
    if len(low) != len(part):  # a letter that becomes two
        low = "".join(c.lower()[0] for c in part)
    for word in SENSITIVE:
        at = low.find(word)
        while at >= 0:
            a = at
            while a and _AROUND.match(part[a - 1]):
                a -= 1
            name = _AROUND.match(part, a)
            if _name_score(name[0]):
                return bool(_SIGNS.search(part))
            at = low.find(word, name.end())
    return False


def _values(text: str, found: list[Assigned]) -> list[_Value]:
    """Each joined value; a value that comes back to itself adds nothing there."""
    entered = [False] * len(found)
    out: list[_Value | None] = [None] * len(found)
    for first in range(len(found)):
        stack = [first]
        while stack:
            i = stack[-1]
            if out[i] is not None:
                stack.pop()
                continue
            below = [] if entered[i] else [p for p in found[i].parts if isinstance(p, int) and not entered[p]]
            entered[i] = True
            if below:
                stack += below
                continue
            value = _Value()
            for p in found[i].parts:
                value.add((out[p] or _Value()) if isinstance(p, int) else _Value.of(text[p[0] : p[1]]))
            out[i] = value
            stack.pop()
    return out


def pairs(text: str) -> list[tuple[int, int]]:
    """Spans of literals whose value reaches a sensitive name, directly or through constants, in order of the text.

    A value is what its operands make when joined; if it passes, all its parts are secrets. Parts that pass by
    themselves are secrets too.
    """
    if not _promising(text):
        return []
    found = Lexer(text, _promising).found
    weights = [max(map(_name_score, one.names), default=0.0) for one in found]
    if not any(weights):
        return []
    values = _values(text, found)
    out: set[tuple[int, int]] = set()
    seen: set[tuple[int, float]] = set()
    whole: set[int] = set()
    for first, weight in enumerate(weights):
        # no part is reached twice at one weight, so that long chains of constants stay linear
        stack = [(first, False)] if weight else []
        while stack:
            i, taken = stack.pop()
            one = found[i]
            if not taken:
                if (i, weight) in seen:
                    continue
                seen.add((i, weight))
                out.update((a, b) for a, b, alone in one.bare if _Value.of(text[a:b]).passes(weight, alone))
                single = {(a, b): alone for a, b, alone in one.bare}
                taken = not (len(one.parts) == 1 and one.parts[0] in single and not single[one.parts[0]]) and values[i].passes(weight)
                if not taken:
                    out.update(p for p in one.parts if not isinstance(p, int) and p not in single and _Value.of(text[p[0] : p[1]]).passes(weight))
            if taken:
                if i in whole:
                    continue
                whole.add(i)
                out.update(p for p in one.parts if not isinstance(p, int) and p[0] < p[1])
            stack += [(p, taken) for p in one.parts if isinstance(p, int)]
    return sorted(out)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns' matches, each kind's leftmost first and without overlap."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), "hex", m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


#: A run of hex digits is matched whole, so short ones can be left out while matching.
_LONG_HEX = re.compile(rf"(?<![0-9a-f])[0-9a-f]{{{LEAST['hex']},}}")


def spans(text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """The base spans, and these with the pairs that no base span covers."""
    base = base_spans(text)
    extra, at, reach = [], 0, -1
    for a, b in pairs(text):
        while at < len(base) and base[at][0] <= a:
            reach = max(reach, base[at][2])
            at += 1
        if b > reach:
            extra.append((a, "pair", b))
    return base, sorted(base + extra, key=lambda s: (s[0], KINDS.index(s[1])))


def _joined(found: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of each whole text: doc_id, n_assign, n_access, n_hex, n_pair, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start and then kind. A null text is an empty one and has
    none; rows are scanned one by one, so that repeated rows give repeated results. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                base, found = spans(text.as_py())
                n = Counter(k for _, k, _ in found)
                rows.append((doc, n["assign"], n["access"], n["hex"], n["pair"], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found)))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            types = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "n_assign", "n_access", "n_hex", "n_pair", "base_sha256", "spans"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_pair long, base_sha256 string, spans string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), blank(text_col).alias("text")).mapInArrow(run, schema)


MASK = "[SECRET]"


def masked(text: str | None) -> str | None:
    """The text with each secret, or run of overlapping ones, replaced by MASK."""
    if not text:
        return text
    out, at = [], 0
    for start, _, end in spans(text)[1]:
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def _masked_series(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(masked, na_action="ignore")
    tidy()


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with secrets masked; all rows and other columns stay, n_chars is brought up to date if there is one."""

    # the text is handed over once; other columns never go to Python
    new = docs.withColumn(text_col, F.pandas_udf(_masked_series, "string")(text_col))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.col(text_col).isNull(), F.col("n_chars")).otherwise(F.length(text_col).cast(docs.schema["n_chars"].dataType)))
    return new.select(*docs.columns)

