"""Joins between nodes, edges and what is known of them. None falls back to a nested loop over both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .steps import cut


def neighbours(nodes: DataFrame, edges: DataFrame, of: DataFrame, direction: str, kinds: list[str] | None = None) -> DataFrame:
    """Distinct nodes one edge away from any of `of`: 'in' for sources of edges into it, 'out' for targets."""
    near, far = ("target_id", "source_id") if direction == "in" else ("source_id", "target_id")
    e = edges.filter(F.col("kind").isin(kinds)) if kinds else edges
    ids = e.join(of.select(F.col("id").alias(near)), near, "left_semi").select(F.col(far).alias("id")).distinct()
    return nodes.join(ids, "id", "left_semi")


def inheritance(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """source_id, id, name of what each node extends or implements."""
    e = edges.filter(F.col("kind").isin("extends", "implements")).select("source_id", F.col("target_id").alias("id"))
    return e.join(nodes.select("id", "name"), "id").select("source_id", "id", "name").distinct()


def inheritance_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """For each node the number of bases and heirs, by the kind of the node at the other end."""
    e = edges.filter(F.col("kind").isin("extends", "implements"))
    kinds = nodes.filter(F.col("kind").isin("class", "struct", "interface")).select(F.col("id").alias("other"), F.col("kind").alias("k"))
    up = e.select(F.col("source_id").alias("id"), F.col("target_id").alias("other")).distinct().join(kinds, "other").withColumn("b", F.when(F.col("k") == "interface", "implements").otherwise("extends"))
    down = e.select(F.col("target_id").alias("id"), F.col("source_id").alias("other")).distinct().join(kinds, "other").withColumn("b", F.when(F.col("k") == "interface", "implemented_by").otherwise("extended_by"))
    both = up.unionByName(down)
    return both.groupBy("id").agg(*[F.count(F.when(F.col("b") == b, 1)).alias(f"n_{b}") for b in ("extends", "implements", "extended_by", "implemented_by")])


def with_ends(edges: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Edges whose both ends are nodes, with the given columns of each end as source_... and target_...."""
    out = edges
    for side in ("source", "target"):
        out = out.join(nodes.select(F.col("id").alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{c}") for c in columns]), f"{side}_id")
    return out


def neighbour_files(edges: DataFrame, nodes: DataFrame, of: Column) -> DataFrame:
    """Files outside `of` (a condition on file) that share an edge with files in it: a union of two equi-joins."""
    ends = with_ends(edges, nodes.withColumn("inside", of), ["file", "inside"])
    out = ends.filter("source_inside AND NOT target_inside").select(F.col("target_file").alias("file"))
    return out.union(ends.filter("target_inside AND NOT source_inside").select("source_file")).distinct()


def importing_files(edges: DataFrame, nodes: DataFrame, pattern: str) -> DataFrame:
    """Files that import a symbol whose qualified name is like the pattern."""
    e = edges.filter(F.col("kind").isin("imports", "imports-type"))
    targets = nodes.filter(F.col("qualified_name").like(pattern)).select(F.col("id").alias("target_id"))
    return e.join(targets, "target_id", "left_semi").join(nodes.select(F.col("id").alias("source_id"), "file"), "source_id").select("file").distinct()


def edges_between(edges: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges from a node of a to one of b or back."""
    ends = [x.select("id") for x in (a, b)]

    def way(s: DataFrame, t: DataFrame) -> DataFrame:
        return edges.join(s.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(t.withColumnRenamed("id", "target_id"), "target_id", "left_semi")

    return way(*ends).unionByName(way(*ends[::-1])).select("source_id", "target_id", "kind").distinct()


def edges_touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with either end among the nodes."""
    ids = nodes.select("id")
    a = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    b = edges.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return a.select(*edges.columns).union(b.select(*edges.columns)).distinct()


def uncalled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions and methods that nothing calls."""
    called = edges.filter("kind = 'calls'").select(F.col("target_id").alias("id"))
    return nodes.filter(F.col("kind").isin("function", "method")).join(called, "id", "left_anti")


def without(left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    return left.join(right.select(F.col(other).alias(key)), key, "left_anti")


def left_default(left: DataFrame, right: DataFrame, key: str, other: str, value: str, default: object, name: str) -> DataFrame:
    """left with right's value for its key, or the default."""
    r = right.select(F.col(other).alias(key), F.col(value).alias(name))
    return left.join(r, key, "left").withColumn(name, F.coalesce(name, F.lit(default)))


def indexed_edges(edges: DataFrame, blocks: DataFrame, owner: str, order: list[str]) -> DataFrame:
    """Edges inside an owner, their ends as 0-based places of its blocks."""
    at = blocks.select(owner, "id", (F.row_number().over(Window.partitionBy(owner).orderBy(*order)) - 1).alias("idx"))
    a = at.select(F.col("id").alias("source_id"), F.col(owner), F.col("idx").alias("from_idx"))
    b = at.select(F.col("id").alias("target_id"), F.col(owner).alias("__o"), F.col("idx").alias("to_idx"))
    return edges.join(a, "source_id").join(b, "target_id").filter(F.col(owner) == F.col("__o")).select(owner, "from_idx", "to_idx", "kind")


def _first_of(nodes: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """(keys, ids): the first `most` ids of each key; the limit is applied before the shuffle too, however common a key is."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    few = nodes.withColumn("__k", turn).filter(F.col("__k") <= most)
    return few.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", "id"))), lambda x: x["id"]).alias("ids"))


#: Lines of a block that ranges and places are filed under.
BLOCK = 64


def enclosing(calls: DataFrame, nodes: DataFrame, group: str) -> DataFrame:
    """For each call (call_id, group, at) the node around its line: a function or method if any, the earliest first.

    Ranges are filed under the blocks of lines that they touch. The distinct places of calls find their first two nodes
    there, by an equi-join of group and block; calls then take their place's first one that isn't themselves.
    """
    n = nodes.filter(F.col("kind").isin("function", "method", "class", "interface", "struct")).select(group, "id", "kind", "line", "end_line")
    places = calls.select(group, "at").distinct().withColumn("__block", F.floor(F.col("at") / BLOCK))
    # a node without an end reaches to the last place of its group
    last = places.groupBy(group).agg(F.max("at").alias("__last"))
    n = n.join(last, group).withColumn("__end", F.when(F.col("end_line") == 0, F.col("__last")).otherwise(F.least("end_line", "__last"))).filter("line <= __end")
    n = n.withColumn("__block", F.explode(F.sequence(F.floor(F.col("line") / BLOCK), F.floor(F.col("__end") / BLOCK))))
    hit = places.join(n, [group, "__block"]).filter((F.col("line") <= F.col("at")) & (F.col("__end") >= F.col("at")))
    first = _first_of(hit, [group, "at"], [F.when(F.col("kind").isin("function", "method"), 0).otherwise(1), F.col("line"), F.col("id")], 2)
    found = calls.join(first, [group, "at"]).select("call_id", F.get(F.filter("ids", lambda x: x != F.col("call_id")), F.lit(0)).alias("enclosing"))
    return found.filter("enclosing IS NOT NULL")


def _candidates(refs: DataFrame, nodes: DataFrame, own: str, tiers: list[tuple[list[str], Column | None]], most: int) -> DataFrame:
    """refs with `tier` (from 1) and `ids`: of the first tier, a list of keys and a condition on nodes, that has other nodes.

    Each tier's nodes are cut to the first few ids of a key before the join, so no name makes pairs of all its nodes.
    """
    out = refs
    for k, (keys, where) in enumerate(tiers):
        found = _first_of(nodes if where is None else nodes.filter(where), keys, [F.col("id")], most + 1).withColumnRenamed("ids", f"__t{k}")
        out = out.join(found, keys, "left").withColumn(f"__t{k}", F.slice(F.filter(f"__t{k}", lambda x: x != F.col(own)), 1, most))
    tier, ids = F.lit(None).cast("int"), F.lit(None).cast("array<long>")
    for k in reversed(range(len(tiers))):
        there = F.coalesce(F.size(f"__t{k}") > 0, F.lit(False))
        tier, ids = F.when(there, k + 1).otherwise(tier), F.when(there, F.col(f"__t{k}")).otherwise(ids)
    return out.select(*refs.columns, tier.alias("tier"), ids.alias("ids")).filter("tier IS NOT NULL")


def resolve_names(calls: DataFrame, nodes: DataFrame, most: int = 3) -> DataFrame:
    """Targets of calls (call_id, name, file, scope) by name: those of the best tier that has any, at most `most`.

    Tiers: same file, same scope, exported, anything else.
    """
    tiers = [(["name", "file"], None), (["name", "scope"], None), (["name"], F.col("exported")), (["name"], None)]
    found = _candidates(calls, nodes, "call_id", tiers, most)
    sure = F.when(F.col("tier") == 1, 1.0).when(F.col("tier") == 2, 0.9).when(F.col("tier") == 3, 0.7).otherwise(0.5)
    return found.select("call_id", F.explode("ids").alias("target"), "tier", sure.alias("confidence"))


def best_match(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each reference (id, name, file, scope) one node of its name: of its file, else of its scope, else any."""
    found = _candidates(refs.withColumnRenamed("id", "__ref"), nodes, "__ref", [(["name", "file"], None), (["name", "scope"], None), (["name"], None)], 1)
    return found.select(F.col("__ref").alias("id"), F.col("ids")[0].alias("best"))


def by_suffix(wants: DataFrame, files: DataFrame) -> DataFrame:
    """Resolve path suffixes (suffix, ...) to files (path): every suffix of a path is a key; the first path of each wins.

    The least path of a suffix is taken before the join, so a suffix that many paths share is one row there.
    """
    p = F.split("path", "/", -1)
    suffixes = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), "/"))).alias("suffix"))
    return wants.distinct().join(suffixes.groupBy("suffix").agg(F.min("path").alias("path")), "suffix")


#: Distinct methods that a bitmap of an owner's methods counts in, so that most owners that lack one are told before a join.
SKETCH = 64


def structural_subtypes(structs: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Structs whose methods hold all of an interface's; owner, method on both sides, (struct, iface, confidence).

    Relational division by candidates: an interface meets only the structs that have its rarest method, and of these only
    those whose bitmap of methods covers its own; each such pair is then verified method by method. A method that all
    structs have is looked up as the rarest only of interfaces that ask for nothing rarer. Interfaces of equal sets of
    methods are one class, and so are structs, and meet once.
    """
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(method), {SKETCH}) AS INT))")

    def classes(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """(owner, class) and (class, methods, bits) of rows(owner, method): a class is a set of methods."""
        sets = rows.distinct().groupBy("owner").agg(F.array_sort(F.collect_list("method")).alias("methods"), F.bit_or(bit).alias("bits"))
        keyed = sets.withColumn(name, F.sha2(F.to_json(F.struct("methods")), 256))
        return keyed.select("owner", name), keyed.dropDuplicates([name]).select(name, "methods", "bits")

    of_struct, struct_sets = classes(structs, "s")
    of_iface, iface_sets = classes(interfaces, "i")
    struct_sets, iface_sets = cut(struct_sets), cut(iface_sets)
    held = struct_sets.select("s", F.explode("methods").alias("method"))
    common = held.groupBy("method").agg(F.count(F.lit(1)).alias("n"))
    asked = iface_sets.select("i", F.explode("methods").alias("method")).join(common, "method", "left")
    # a method that no struct has rules the interface out: its count is null, which comes first
    rarest = asked.groupBy("i").agg(F.min(F.struct("n", "method")).alias("r")).filter("r.n is not null").select("i", "r.method")
    wants = rarest.join(iface_sets.select("i", "methods", F.col("bits").alias("asked")), "i").withColumnRenamed("methods", "need")
    offers = held.join(struct_sets, "s")
    pairs = wants.join(offers, "method").filter(F.col("asked").bitwiseAND(F.col("bits")) == F.col("asked")).filter(F.size(F.array_except("need", "methods")) == 0).select("s", "i")
    found = pairs.join(of_struct.withColumnRenamed("owner", "struct"), "s").join(of_iface.withColumnRenamed("owner", "iface"), "i")
    return found.select("struct", "iface", F.lit(0.8).alias("confidence"))


def rule_violations(edges: DataFrame, nodes: DataFrame, rules: list[tuple[int, str, str, str]], most: int) -> DataFrame:
    """Edges that deny-rules (id, kind, from, to: parts of file paths) forbid, at most `most` of each rule.

    The rules are a literal list: each edge finds its rules in one pass, without a join.
    """
    deny = [(i, f, t) for i, kind, f, t in rules if kind == "deny"]
    if not deny:
        return edges.select(F.lit(0).alias("rule"), "source_id", "target_id").limit(0)
    e = with_ends(edges, nodes, ["file"])
    hit = F.filter(F.array(*[F.when(F.contains("source_file", F.lit(f)) & F.contains("target_file", F.lit(t)), i) for i, f, t in deny]), lambda x: x.isNotNull())
    found = e.select("source_id", "target_id", "kind", F.explode(hit).alias("rule"))
    k = F.row_number().over(Window.partitionBy("rule").orderBy("source_id", "target_id", "kind"))
    return found.withColumn("k", k).filter(F.col("k") <= most).select("rule", "source_id", "target_id")


def owner_boundaries(edges: DataFrame, nodes: DataFrame, owners: DataFrame) -> DataFrame:
    """Edges between files whose sets of owners differ; owners(file, owners array)."""
    sets = owners.select("file", F.array_sort(F.array_distinct("owners")).alias("owners"))
    e = with_ends(edges, nodes.join(sets, "file"), ["file", "owners"])
    return e.filter("source_file <> target_file AND source_owners <> target_owners")
