"""Line dedup by a log-template tree, in DataFrame functions alone.

Lines that are equal but for white space recur as they are. The rest goes by templates. A fixed-depth parse tree routes a
line by its number of tokens and its leading token; tokens with a digit count as variable and are masked. In a leaf, a line
is filed under several templates: its other tokens fall into consecutive fields, each of at most OPEN_TENTHS of the line's
tokens, and each template has one of these fields open (a wildcard). A short line, of under OPEN_FROM tokens, has one
template, in which only tokens with a digit are open.

A template must prove that it is one. At least two of its tokens, and half of them, are literal, so lines of numbers are
none; and it needs LINES different lines or more from two documents or more, so two sentences that happen to differ in a
word are none either. No pair of lines is ever compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, hot_join, materialise, split_hot

#: Tenths of a line's tokens that an open field may hold, the most fields that this gives, and the tokens of a line that has some.
OPEN_TENTHS, FIELDS, OPEN_FROM = 3, 5, 8
#: Different lines that make a template, and literal tokens in it.
LINES, LITERALS = 3, 2


def _spaced(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\x0b\x0c\r", "    "))


def _exact(line: Column) -> Column:
    """A hash of the line's tokens."""
    return F.xxhash64(F.when(F.instr(line, "  ") > 0, F.regexp_replace(line, " +", " ")).otherwise(line))


def _templates(line: Column) -> Column:
    """The template keys of a spaced line that is not blank."""
    none = F.array().cast("array<bigint>")

    def enough(n: Column, literals: Column) -> Column:
        return (literals >= LITERALS) & (2 * literals >= n)

    def literal(t: Column) -> Column:
        return F.size(F.array_remove(t, "0"))

    def fields(t: Column, width: Column) -> list[Column]:
        return [F.slice(t, 2 + width * k, width) for k in range(FIELDS)]

    def keys(parts: Column, n: Column, width: Column) -> Column:
        """A key for each field left open, of the hashes of the start and of the fields."""
        made = bind(parts, lambda p: F.array(*[F.xxhash64(F.lit(k), *[p[j] for j in range(FIELDS + 1) if j != k + 1]) for k in range(FIELDS)]))
        return F.slice(made, F.lit(1), F.ceil((n - 1) / width).cast("int"))

    def hashes(t: Column, n: Column, width: Column) -> Column:
        return F.array(F.xxhash64(n, t[0]), *[F.xxhash64(f) for f in fields(t, width)])

    # without digits, a line of OPEN_FROM tokens is literal enough whichever field is open, and a shorter one has no template
    def of_words(t: Column) -> Column:
        n = F.size(t)
        width = F.floor(n * OPEN_TENTHS / 10).cast("int")
        return F.when(n < OPEN_FROM, none).otherwise(keys(hashes(t, n, width), n, width))

    def of_mixed(t: Column) -> Column:
        n, literals = F.size(t), literal(t)
        width = F.floor(n * OPEN_TENTHS / 10).cast("int")
        short = F.when(enough(n, literals), F.array(F.xxhash64(F.lit(-1), t))).otherwise(none)
        able = F.array(*[enough(n, literals - literal(f)) for f in fields(t, width)])
        long = F.filter(F.transform(keys(hashes(t, n, width), n, width), lambda key, k: F.when(able[k], key)), lambda key: key.isNotNull())
        return F.when(n < OPEN_FROM, short).otherwise(long)

    masked = F.regexp_replace(line, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", "0")
    return F.when(line.rlike("[0-9]"), bind(F.split(masked, " +", -1), of_mixed)).otherwise(bind(F.split(line, " +", -1), of_words))


def bind(value: Column, use) -> Column:
    """use(value), with the value computed once however often `use` names it."""
    return F.transform(F.array(value), use)[0]


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines to drop, as (doc long, text_hash, dropped array<int> of line numbers from 0).

    A line recurs if two documents have it; it stays in the one of smallest id. Lines that so stay are dropped if a template
    of theirs holds LINES different lines or more and its lines' first documents differ; they stay where that is the smallest
    of them. All that a line or template is asked combines on the map side, however common it is.
    """
    # hashed before the lines are laid out: beside them, the text would go along with each of its lines
    split = docs.filter(F.col(text_col).isNotNull()).select(_doc(id_col).alias("doc"), F.xxhash64(text_col).alias("text_hash"), F.split(text_col, "\n", -1).alias("lines"))
    lines = split.select("doc", "text_hash", F.posexplode("lines").alias("pos", "line")).withColumn("line", _spaced(F.col("line"))).filter("line <> ''")
    filed = materialise(lines.select("doc", "text_hash", "pos", _exact(F.col("line")).alias("exact"), _templates(F.col("line")).alias("keys")))
    n_lines = filed.count()
    row = F.xxhash64("doc", "text_hash", "pos")
    same = filed.groupBy("exact").agg(F.min("doc").alias("first"), F.min(row).alias("row"), F.count(F.lit(1)).alias("n"))
    same = materialise(same.filter("n > 1"))
    # rows of lines that occur once have neither first nor row
    known = materialise(split_hot(filed, same, "exact", n_lines, "left"))
    # each different line once, whichever of its rows that is
    different = known.filter(F.col("row").isNull() | (F.col("row") == row)).select(F.coalesce("first", "doc").alias("first"), F.explode("keys").alias("key"))
    made = different.groupBy("key").agg(F.min("first").alias("least"), F.max("first").alias("last"), F.count(F.lit(1)).alias("n"))
    made = materialise(made.filter(f"n >= {LINES} and least <> last").select("key", "least", "n"))
    stays = known.filter("first is null or doc = first")
    keyed = stays.select("doc", "text_hash", "pos", F.explode("keys").alias("key"))
    most = stays.agg(F.sum(F.size("keys"))).first()[0] or 0
    by_template = hot_join(keyed, made, "key", most).filter("doc <> least").select("doc", "text_hash", "pos")
    hits = known.filter("doc <> first").select("doc", "text_hash", "pos").unionByName(by_template)
    return hits.groupBy("doc", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def _doc(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)).cast("long"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", detail: bool = False, emptied: bool = True) -> DataFrame:
    """The documents without lines whose template recurs in a document of smaller id; all columns stay.

    Lines are what "\\n" splits. Null texts stay null and empty ones empty. A document that loses every line that is not
    blank is like documents of smaller ids throughout: its row stays with what blank lines it has, or goes if `emptied`
    is false. Rows of one id are one document, and null ids are together one document before all others; repeated rows
    are treated alike. Blank lines always stay. An empty table gives an empty one. A column n_chars is brought up to
    date. Columns of any other name are carried. With detail, columns n_lines and n_dropped are added (0 lines for a null
    text) in place of any of that name.
    """
    doc, hashed, drop, n_lines, n_dropped = fresh(docs, "doc", "hash", "drop", "n_lines", "n_dropped")
    drops = recurring_lines(docs, id_col, text_col).select(F.col("doc").alias(doc), F.col("text_hash").alias(hashed), F.col("dropped").alias(drop))
    keyed = docs.withColumns({doc: _doc(id_col), hashed: F.xxhash64(text_col)})
    out = keyed.join(drops, [doc, hashed], "left")

    def kept(ls: Column) -> Column:
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(drop)), lambda i: ls[i]), "\n")

    text = bind(F.split(text_col, "\n", -1), kept)
    text = F.when(F.col(drop).isNull(), F.col(text_col)).otherwise(text)
    new = {text_col: text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(drop).isNull(), F.col("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    if detail:
        new[n_lines] = F.coalesce(F.size(F.split(text_col, "\n", -1)), F.lit(0))
        new[n_dropped] = F.coalesce(F.size(drop), F.lit(0))
    out = out.withColumns(new)
    if not emptied:
        out = out.filter(F.col(drop).isNull() | (F.trim(F.translate(text_col, "\t\x0b\x0c\r\n", "     ")) != ""))
    cols = [F.col(c) for c in docs.columns if not detail or c not in ("n_lines", "n_dropped")]
    if detail:
        cols += [F.col(n_lines).alias("n_lines"), F.when(F.col(n_dropped) < 0, 0).otherwise(F.col(n_dropped)).alias("n_dropped")]
    return out.select(*cols)
