"""Scalar functions on text, paths and names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_to_regex(glob: str) -> str:
    """* is anything, ? one character, all else itself; the whole text must match."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob) + "$"


def occurrences(text: Column, part: str) -> Column:
    """How often part comes up in text, without overlap."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(part)))) / len(part)).cast("int")


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def quoted_query(query: Column) -> Column:
    """A full-text query as quoted lower-case words, all of which must match; empty without words."""
    return F.array_join(F.transform(words(F.coalesce(query, F.lit(""))), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " ")


def plain_query(query: Column) -> Column:
    """A query with its ASCII punctuation and other signs as single blanks; case stays."""
    return F.trim(F.regexp_replace(F.regexp_replace(query, r"[^A-Za-z0-9_\s]", " "), r"\s+", " "))


def tokens_of_bytes(text: Column, per_token: float = 2.5) -> Column:
    """An estimate of tokens: whole multiples of per_token bytes."""
    return F.floor(F.octet_length(text) / F.lit(per_token)).cast("int")


def truncated(text: Column, most: int, tail: int = 100, mark: str = "\n...\n") -> Column:
    """The text if it fits, else its head and a mark, and beyond 300 characters also its tail."""
    head = most - len(mark) - (tail if most > 300 else 0)
    cut = F.concat(F.substring(text, 1, head), F.lit(mark), F.expr("''") if most <= 300 else F.right(text, F.lit(tail)))
    return F.when(F.length(text) <= most, text).otherwise(cut)


def signature(kind: Column, qualified: Column, name: Column) -> Column:
    prefix = F.when(kind.isin("function", "method"), "func").when(kind == "class", "class").when(kind == "interface", "interface").otherwise("symbol")
    return F.concat_ws(" ", prefix, F.coalesce(F.nullif(qualified, F.lit("")), name))


def description(qualified: Column, name: Column, kind: Column, file: Column, doc: Column) -> Column:
    """The text that stands for a symbol in an embedding."""
    return F.concat_ws(" ", F.coalesce(F.nullif(qualified, F.lit("")), name), F.concat(F.lit("("), kind, F.lit(")")), F.concat(F.lit("in "), file), F.nullif(doc, F.lit("")))


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*\z", 1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def extension(path: Column) -> Column:
    """Lower-cased, with its dot; empty without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1))


#: Languages by extension.
LANGUAGES = {
    ".js": "javascript", ".ts": "typescript", ".tsx": "tsx", ".py": "python", ".go": "go", ".rs": "rust",
    ".java": "java", ".cs": "csharp", ".c": "c", ".cpp": "cpp",
}


def language(path: Column) -> Column:
    """The language of a file by its extension, or null."""
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[extension(path)]


def folded(path: Column) -> Column:
    """A relative path without . and .. parts; a .. at the top stays."""

    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.element_at(done, F.when(F.size(done) > 0, -1).otherwise(F.lit(None))) != "..")
        return F.when(part.isin("", "."), done).when(up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


#: Texts that count as a decision each time they come up, also inside each other, and more of them by language.
DECISIONS = (
    "if ", "if(", "else if", "elif ", "elif(", "for ", "for(", "while ", "while(", "switch ", "switch(", "case ", "catch ", "catch(",
    "except ", "except(", "&&", "||", "and ", "or ", "?",
)
MORE_DECISIONS = {"go": ("select ", "select{"), "rust": ("match ", "match{", "loop "), "python": ("for ", "in ")}
#: Beginnings of lines that open a control structure, and of those that are its other branches.
CONTROL = ("if ", "if(", "for ", "for(", "while ", "while(", "switch ", "switch(", "try ", "try{", "catch ", "catch(", "except ", "except(", "loop ", "loop{", "select ", "select{")
BRANCHES = ("else ", "else{", "else if", "elif ", "elif(", "except ", "except(", "case ", "default ")
LOGICAL = ("&&", "||", "and ", "or ")
#: Operators of one and two signs, and words that count as operators.
PAIRS = ("++", "--", "==", "!=", "<=", ">=", "&&", "||", "+=", "-=", "*=", "/=", "->", "=>", "::", "<<", ">>")
OPERATOR_WORDS = (
    "if", "else", "for", "while", "do", "switch", "case", "default", "break", "continue", "return", "throw", "try", "catch", "finally", "new", "delete", "typeof", "instanceof", "in", "of",
    "go", "defer", "chan", "select", "range", "make", "append", "len", "let", "mut", "match", "loop", "unsafe", "async", "await",
)


def bare(line: Column) -> Column:
    """A line without white space around it."""
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def starts_with_any(line: Column, heads: tuple[str, ...]) -> Column:
    return line.rlike("^(" + "|".join(re.escape(h) for h in heads) + ")")


def cyclomatic(code: Column, language: Column) -> Column:
    """One more than the decisions in the code."""
    out = F.lit(1)
    for part in DECISIONS:
        out = out + occurrences(code, part)
    for lang, parts in MORE_DECISIONS.items():
        out = out + F.when(language == lang, sum((occurrences(code, p) for p in parts), F.lit(0))).otherwise(0)
    return out


def code_lines(code: Column) -> Column:
    """Lines that are neither blank nor comment (//, #, -- and /* */ over lines)."""

    def step(acc: Column, line: Column) -> Column:
        opens, closes = line.startswith("/*"), line.contains("*/")
        counted = ~acc["inside"] & ~opens & (line != "") & ~line.rlike("^(//|#|--)")
        return F.struct((acc["n"] + counted.cast("int")).alias("n"), ((acc["inside"] | opens) & ~closes).alias("inside"))

    return F.aggregate(F.transform(F.split(code, "\n"), bare), F.struct(F.lit(0).alias("n"), F.lit(False).alias("inside")), step, lambda acc: acc["n"])


def nesting(code: Column, language: Column) -> Column:
    """The greatest depth of braces outside comment lines, or in Python of four blanks of indent."""
    lines = F.filter(F.split(code, "\n"), lambda s: ~bare(s).rlike(r"^(//|#|/\*)"))
    signs = F.regexp_extract_all(F.array_join(lines, ""), F.lit("([{}])"), 1)

    def step(acc: Column, s: Column) -> Column:
        now = F.greatest(acc["now"] + F.when(s == "{", 1).otherwise(-1), F.lit(0))
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    braces = F.aggregate(signs, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda acc: acc["most"])
    indents = F.coalesce(F.array_max(F.transform(lines, lambda s: F.floor(F.length(F.regexp_extract(s, r"^([ \t]*)", 1)) / 4).cast("int"))), F.lit(0))
    return F.when(language == "python", F.greatest(braces, indents)).otherwise(braces)


def cognitive(code: Column) -> Column:
    """A control structure adds one and the depth it stands in, another branch and each logical operator one."""

    def step(acc: Column, line: Column) -> Column:
        opens = starts_with_any(line, CONTROL).cast("int")
        more = starts_with_any(line, BRANCHES).cast("int") + sum((occurrences(line, op) for op in LOGICAL), F.lit(0))
        total = acc["sum"] + opens * (1 + acc["depth"]) + more
        return F.struct(total.cast("int").alias("sum"), F.greatest(acc["depth"] + opens - line.endswith("}").cast("int"), F.lit(0)).alias("depth"))

    return F.aggregate(F.transform(F.split(code, "\n"), bare), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("depth")), step, lambda acc: acc["sum"])


_WORD = r"""[^\s+\-*/%=!<>&|^~:()\[\]{},;"'`]+"""
_TEXT = "|".join(rf"{q}.*?(?:(?<!\\){q}|\z)" for q in "\"'`")
#: Comments go; else the whole next token is seen ahead, and of two signs that are one operator only the first is passed.
_TOKENS = rf"(?s)//[^\n]*|/\*[^\n]*|(?=({_TEXT}|{'|'.join(map(re.escape, PAIRS))}|[-+*/%=!<>&|^~:()\[\]{{}},;]|{_WORD}))(?:{_TEXT}|[-+*/%=!<>&|^~:()\[\]{{}},;]|{_WORD})"


def halstead(code: Column) -> Column:
    """volume, difficulty, effort, time, bugs from operators (signs and words) and operands (other words, numbers, texts).

    A second sign counts once as part of an operator of two and once more as what it begins.
    """
    tokens = F.filter(F.regexp_extract_all(code, F.lit(_TOKENS), 1), lambda t: t != "")
    is_operator = lambda t: t.isin(".", *OPERATOR_WORDS) | t.rlike(r"^[-+*/%=!<>&|^~:()\[\]{},;]")
    operators = F.filter(tokens, is_operator)
    operands = F.filter(tokens, lambda t: ~is_operator(t) & t.rlike(r"""^[\p{L}_\p{Nd}"'`]"""))
    n1, n2, all1, all2 = (F.size(F.array_distinct(operators)), F.size(F.array_distinct(operands)), F.size(operators), F.size(operands))
    volume = F.when(n1 + n2 > 0, (all1 + all2) * F.log2(n1 + n2)).otherwise(0.0)
    difficulty = F.when(n2 > 0, n1 / 2 * (all2 / n2)).otherwise(0.0)
    effort = volume * difficulty
    return F.struct(volume.alias("volume"), difficulty.alias("difficulty"), effort.alias("effort"), (effort / 18).alias("time"), (volume / 3000).alias("bugs"))


def mutation(code: Column) -> Column:
    """The kind of change that a statement makes to a variable."""
    has = code.contains
    return F.when(has("++") | has("+="), "increment").when(has("--") | has("-="), "decrement").when(has("*="), "multiply").when(has("/="), "divide").otherwise("unknown")


def identifiers(code: Column) -> Column:
    """Words of letters, digits and underscores that begin with no digit, in order."""
    return F.filter(F.regexp_extract_all(code, F.lit("([A-Za-z0-9_]+)"), 1), lambda w: ~w.rlike("^[0-9]"))


def source_text(code: Column) -> Column:
    """What follows the first = of an assignment; empty without one."""
    return F.regexp_extract(code, r"(?s)^[^=]*=(.+)\z", 1)


def call_arguments(code: Column) -> Column:
    """The arguments of the first call, parted at commas outside inner brackets; empty parts go."""

    def step(acc: Column, c: Column) -> Column:
        depth = acc["depth"] + F.when(c.isin("(", "[", "{"), 1).when(c.isin(")", "]", "}"), -1).otherwise(0)
        starts, ends = (acc["depth"] == 0) & (c == "("), (depth == 0) & (c == ")") & ~acc["done"]
        parts = (c == ",") & (acc["depth"] == 1) | ends
        inside = (acc["depth"] > 0) & ~acc["done"]
        out = F.when(inside & parts & (acc["now"] != ""), F.array_append(acc["out"], F.trim(acc["now"]))).otherwise(acc["out"])
        now = F.when(~inside | parts, "").otherwise(F.concat(acc["now"], c))
        # before the call, other brackets don't count
        return F.struct(F.when((acc["depth"] == 0) & ~starts, 0).otherwise(F.greatest(depth, F.lit(0))).alias("depth"), (acc["done"] | inside & ends).alias("done"), now.alias("now"), out.alias("out"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("done"), F.lit("").alias("now"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(F.split(code, ""), start, step, lambda acc: F.when(acc["done"], acc["out"]).otherwise(F.array().cast("array<string>")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a zero vector or unlike lengths."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))


def match_score(name: Column, query: str, exported: Column) -> tuple[Column, Column]:
    """exact, prefix or partial, and 3, 2 or 1 with half a point more for an exported name; letters of either case are alike."""
    low, q = F.lower(name), query.lower()
    kind = F.when(low == q, "exact").when(low.startswith(q), "prefix").otherwise("partial")
    return kind, F.when(low == q, 3.0).when(low.startswith(q), 2.0).otherwise(1.0) + F.when(exported, 0.5).otherwise(0.0)


def grouped_by_budget(sizes: Column, budget: int) -> Column:
    """The group of each item in turn: a group closes when the next item would exceed the budget."""

    def step(acc: Column, n: Column) -> Column:
        over = (acc["sum"] + n > budget) & (acc["sum"] > 0)
        group = acc["group"] + over.cast("int")
        return F.struct(F.concat(acc["out"], F.array(group)).alias("out"), group.alias("group"), F.when(over, n).otherwise(acc["sum"] + n).cast("long").alias("sum"))

    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("group"), F.lit(0).cast("long").alias("sum"))
    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def chunks(text: Column, budget: int) -> Column:
    """The text's lines in runs of at most `budget` estimated tokens (a longer line is a run of its own): array of texts, null for none."""
    lines = F.split(text, "\n")
    groups = grouped_by_budget(F.transform(lines, lambda s: tokens_of_bytes(s) + 1), budget)
    numbered = F.arrays_zip(lines.alias("line"), groups.alias("group"))
    runs = F.transform(F.array_distinct(groups), lambda g: F.array_join(F.transform(F.filter(numbered, lambda x: x["group"] == g), lambda x: x["line"]), "\n"))
    return F.when((text != "") & F.lit(budget > 0), runs)
