"""Walks over a graph: breadth-first depths, paths, closures and what is built from them.

A round of a walk is one equi-join of the frontier with the edges and one anti-join with what was met before, written
to the shared folder; the driver only learns whether the frontier is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import lots as L
from .steps import arrows, cut, discard


def walk(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, node, depth) for seeds(root, node) over edges(src, dst): least depths, seeds at 0. Null seeds are dropped."""
    reached = frontier = cut(seeds.select("root", "node").filter("root IS NOT NULL AND node IS NOT NULL").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(reached.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, direction: str = "out") -> DataFrame:
    """(node, depth) from seeds(id) over edges(source_id, target_id), seeds at depth 0."""
    start = seeds.select(F.lit(0).alias("root"), F.col("id").alias("node"))
    return walk(cut(arrows(edges, direction)), start, max_depth).select("node", "depth")


def impact(edges: DataFrame, seeds: DataFrame, max_depth: int = 3) -> DataFrame:
    """Callers of the seeds, direct or not, without the seeds: (id, depth)."""
    return bfs(edges.filter("kind = 'calls'"), seeds, max_depth, "in").filter("depth > 0").withColumnRenamed("node", "id")


def impact_of_each(edges: DataFrame, seeds: DataFrame, max_depth: int = 3) -> DataFrame:
    """Least depth over the seeds' own impacts: (id, depth); a seed that another seed reaches is in."""
    start = seeds.select(F.col("id").alias("root"), F.col("id").alias("node"))
    met = walk(cut(arrows(edges.filter("kind = 'calls'"), "in")), start, max_depth).filter("depth > 0")
    return met.groupBy(F.col("node").alias("id")).agg(F.min("depth").alias("depth"))


def dependencies(edges: DataFrame, root: int, max_depth: int, direction: str = "out") -> DataFrame:
    """(id, depth, direct): depth 1 is direct; a root that a cycle returns to is in, at the depth of its return."""
    hops = cut(arrows(edges, direction))
    first = hops.filter(F.col("src") == root).select(F.lit(0).alias("root"), F.col("dst").alias("node"))
    return walk(hops, first, max_depth - 1).select(F.col("node").alias("id"), (F.col("depth") + 1).alias("depth"), (F.col("depth") == 0).alias("direct"))


def call_chains(edges: DataFrame, source: int, target: int, max_edges: int) -> DataFrame:
    """All simple paths from source to target of at most max_edges edges: (path array, n_edges). None if they are equal."""
    hops = cut(arrows(edges))
    # nodes that can't reach the target in time would only grow the paths
    left = walk(hops.select(F.col("dst").alias("src"), F.col("src").alias("dst")), hops.sparkSession.createDataFrame([(0, target)], "root long, node long"), max_edges)
    left = cut(left.select(F.col("node").alias("dst"), F.col("depth").alias("left")))
    paths = hops.sparkSession.createDataFrame([([source], source)], "path array<long>, at long")
    found = None
    for n in range(1, max_edges + 1):
        if source == target:
            break
        grown = paths.join(hops, F.col("at") == F.col("src")).filter(~F.array_contains("path", F.col("dst")))
        grown = grown.join(left.filter(F.col("left") <= max_edges - n), "dst")
        paths = cut(grown.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at")))
        hits = paths.filter(F.col("at") == target).select("path", F.lit(n).alias("n_edges"))
        found = hits if found is None else found.unionByName(hits)
        paths = paths.filter(F.col("at") != target)
    return found if found is not None else paths.select("path", F.lit(0).alias("n_edges")).limit(0)


def shortest_path(edges: DataFrame, source: int, target: int, max_depth: int = 20) -> DataFrame:
    """(step, id) of one shortest path, the smallest ids where several lead on; no rows if there is none."""
    spark = edges.sparkSession
    hops = cut(arrows(edges))
    depth = walk(hops, spark.createDataFrame([(0, source)], "root long, node long"), max_depth)
    far = depth.filter(F.col("node") == target).first()
    rows, at = [(0, source)] if far else [], target
    for d in range(far["depth"] if far else 0, 0, -1):
        rows.append((d, at))
        before = depth.filter(F.col("depth") == d - 1).join(hops.filter(F.col("dst") == at), F.col("node") == F.col("src"), "left_semi")
        at = before.agg(F.min("node")).first()[0]
    return spark.createDataFrame(sorted(rows), "step int, id long")


def neighbours(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "both", kinds: list[str] | None = None) -> DataFrame:
    """(id, depth, score) of what lies within `depth`, without the seeds; the score falls by a fifth for each step."""
    kept = edges.filter(F.col("kind").isin(kinds)) if kinds else edges
    near = bfs(kept, seeds, depth, direction).filter("depth > 0")
    return near.select(F.col("node").alias("id"), "depth", F.round(1 - 0.2 * F.col("depth"), 2).alias("score"))


def file_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges between different files: source_id and target_id are files."""
    s, t = nodes.select(F.col("id").alias("source_id"), F.col("file").alias("sf")), nodes.select(F.col("id").alias("target_id"), F.col("file").alias("tf"))
    return edges.join(s, "source_id").join(t, "target_id").filter("sf <> tf").select(F.col("sf").alias("source_id"), F.col("tf").alias("target_id")).distinct()


def importer_files(nodes: DataFrame, edges: DataFrame, file: str, max_depth: int = 4) -> DataFrame:
    """(file, depth) of files that import `file`, directly or through others."""
    g = file_graph(nodes, edges.filter("kind = 'imports'"))
    seed = g.sparkSession.createDataFrame([(file,)], "id string")
    return bfs(g, seed, max_depth, "in").filter("depth > 0").withColumnRenamed("node", "file")


def descendants(tree: DataFrame, root: str) -> DataFrame:
    """(id, depth) below root in tree(id, parent_id)."""
    edges = tree.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("source_id"), F.col("id").alias("target_id"))
    return bfs(edges, tree.sparkSession.createDataFrame([(root,)], "id string")).filter("depth > 0").withColumnRenamed("node", "id")


def ancestors(tree: DataFrame, leaf: str) -> DataFrame:
    """(id, depth) above leaf."""
    edges = tree.filter("parent_id IS NOT NULL").select(F.col("id").alias("source_id"), F.col("parent_id").alias("target_id"))
    return bfs(edges, tree.sparkSession.createDataFrame([(leaf,)], "id string")).filter("depth > 0").withColumnRenamed("node", "id")


def messages(nodes: DataFrame, edges: DataFrame, root: int, max_depth: int = 10) -> DataFrame:
    """Calls between files that a sequence diagram of root shows: (depth, from_file, to_file, caller, callee)."""
    calls = edges.filter("kind = 'calls'")
    met = bfs(calls, nodes.filter(F.col("id") == root), max_depth - 1)
    n = nodes.select("id", "name", "file")
    out = met.join(arrows(calls), F.col("node") == F.col("src"))
    out = out.join(n.select(F.col("id").alias("src"), F.col("file").alias("from_file"), F.col("name").alias("caller")), "src")
    out = out.join(n.select(F.col("id").alias("dst"), F.col("file").alias("to_file"), F.col("name").alias("callee")), "dst")
    return out.select("depth", "src", "dst", "from_file", "to_file", "caller", "callee")


def distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, target, distance) over sources(id), all finite distances above 0. As large as the closure of the sources."""
    start = sources.select(F.col("id").alias("root"), F.col("id").alias("node"))
    return walk(cut(arrows(edges)), start).filter("depth > 0").select(F.col("root").alias("source"), F.col("node").alias("target"), F.col("depth").alias("distance"))


def cycle_paths(edges: DataFrame, max_length: int = 5, most: int = 100) -> DataFrame:
    """(path, length) of the shortest simple cycles of more than one node, each from its smallest node, at most `most`.

    Walks begin at every node and go on to greater nodes only, so a cycle is met once; after each round, those that
    closed leave. Length and number are the feature's own bounds.
    """
    ways = cut(arrows(edges).filter("src <> dst"))
    open_ = cut(ways.filter("src < dst").select(F.array("src", "dst").alias("path"), F.col("src").alias("first"), F.col("dst").alias("last")))
    found = None
    for length in range(2, max_length + 1):
        step = open_.join(ways, F.col("last") == F.col("src"))
        closed = cut(step.filter("dst = first").select("path", F.lit(length).alias("length")).orderBy("path").limit(most))
        found = closed if found is None else found.unionByName(closed)
        if length < max_length:
            onward = step.filter(F.col("dst") > F.col("first")).filter(~F.array_contains("path", F.col("dst")))
            open_ = cut(onward.select(F.array_append("path", F.col("dst")).alias("path"), "first", F.col("dst").alias("last")))
    return found.orderBy("length", "path").limit(most)


def path_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(distance, pairs): how many ordered pairs of nodes are at each finite distance above 0.

    Weak components that a task can take whole are walked there from a block of sources at a time; larger ones by rounds.
    """
    known = nodes.select(F.col("id").alias("src"), F.lit(True).alias("known")).distinct()
    ways = cut(arrows(edges).filter("src <> dst").join(known, "src", "left").select("src", "dst", F.lit(1.0).alias("w"), F.coalesce("known", F.lit(False)).alias("known")))
    packed, rest = L.lots(ways)
    counts = L.each_block(packed, ["src", "dst"], L.pairs_by_distance, "distance int, pairs long")
    if rest is not None:
        counts = counts.unionByName(_counts_by_rounds(rest.filter("known").select(F.col("src").alias("node")).distinct(), rest.select("src", "dst")))
    out = cut(counts.groupBy("distance").agg(F.sum("pairs").alias("pairs")))
    for done in (packed, ways, rest):
        if done is not None:
            discard(done)
    return out


def _counts_by_rounds(sources: DataFrame, ways: DataFrame) -> DataFrame:
    """path_counts from sources(node) over ways(src, dst).

    Each node carries bitmaps of the nodes that reach it, one for each block of 32 768 source ids that has any; a round
    is one join with the edges and one union of bitmaps, so pairs are bits and no row is made for a pair.
    """
    state = cut(sources.groupBy("node", F.bitmap_bucket_number("node").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("node")).alias("from")))
    counts, known, distance = [], state.agg(F.coalesce(F.sum(F.bitmap_count("from")), F.lit(0))).first()[0], 0
    while True:
        onward = state.join(ways, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "block", "from")
        before, state = state, cut(state.unionByName(onward).groupBy("node", "block").agg(F.bitmap_or_agg("from").alias("from")))
        discard(before)
        now = state.agg(F.coalesce(F.sum(F.bitmap_count("from")), F.lit(0))).first()[0]
        if now == known:
            return ways.sparkSession.createDataFrame(counts, "distance int, pairs long")  # one row for each distance
        distance += 1
        counts.append((distance, now - known))
        known = now


def path_lengths(counts: DataFrame) -> DataFrame:
    """Diameter and average length of path_counts()."""
    average = F.sum(F.col("distance") * F.col("pairs")) / F.sum("pairs")
    return counts.agg(F.coalesce(F.max("distance"), F.lit(0)).alias("diameter"), F.round(F.coalesce(average, F.lit(0.0)), 8).alias("average_path"))
