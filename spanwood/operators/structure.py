"""Whole-graph algorithms as rounds of joins and aggregates: components, ranks, centralities, communities, roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import pagerank as pagerank
from .steps import both_ways, cut, discard, simple, wide


def _ids(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("id").alias("node")).filter("node IS NOT NULL").distinct()


def _lowered(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node's label or the least label of an in-neighbour, whichever is less."""
    came = edges.join(labels.hint("merge"), F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("__came"))
    return labels.join(came.hint("merge"), "node", "left").select("node", F.least("label", "__came").alias("label"))


def _total(labels: DataFrame):
    """Labels only ever fall, so an unchanged sum means that none did."""
    return labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]


def _settle(labels: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    labels, last = wide(labels), None
    while (total := _total(labels)) != last:
        last = total
        before = labels
        for _ in range(hops):
            labels = _lowered(labels, edges)
        labels = wide(labels)
        discard(before)
    return labels


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id joined to it when directions are ignored.

    Large-star and small-star contractions in turn (Kiveris et al., 2014): each links every neighbour to the least one
    around, first of a node's larger neighbours, then of the others, until all hang on their component's least node. A round
    joins on nodes, never on labels, so a component of most nodes is no key of its own; rounds grow with the logarithm of
    a component's size. A round's table goes when the next one stands.
    """
    ids = cut(_ids(nodes))
    links = cut(simple(nodes, edges).select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    state, last = _state(links), None
    while state != last:
        last = state
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        before, links = links, cut(small.filter("u <> v").distinct())
        state = _state(links)
        discard(before)
    return ids.join(links.select(F.col("u").alias("node"), "v"), "node", "left").select(F.col("node").alias("id"), F.coalesce("v", "node").alias("component"))


def _state(links: DataFrame) -> tuple:
    """What tells whether a round changed links(u, v)."""
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first())


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id on a common cycle, or the node itself.

    Nodes without an edge in or out among those that are left are components of their own and go first, in rounds. The
    rest learn the least id that reaches them and the least id that they reach. Where both are the same id, the node is
    on a cycle with it; of the others, only edges between nodes that agree in both can lie on a cycle.
    """
    left, g, known = wide(_ids(nodes)), wide(simple(nodes, edges)), None
    while not g.isEmpty():
        while True:
            n = g.count()
            keep = wide(g.select(F.col("src").alias("node")).distinct().join(g.select(F.col("dst").alias("node")), "node", "left_semi"))
            g = wide(g.join(keep.select(F.col("node").alias("src")), "src", "left_semi").join(keep.select(F.col("node").alias("dst")), "dst", "left_semi"))
            if g.count() == n:
                break
        if not n:
            break
        start = keep.withColumn("label", F.col("node"))
        ahead = _settle(start, g, hops=4)
        back = _settle(start, g.select(F.col("dst").alias("src"), F.col("src").alias("dst")), hops=4)
        both = wide(ahead.select("node", F.col("label").alias("a")).join(back.select("node", F.col("label").alias("b")), "node"))
        found = both.filter("a = b").select("node", F.col("a").alias("component"))
        known = found if known is None else known.unionByName(found)
        rest = both.filter("a <> b")
        own = g.join(rest.select(F.col("node").alias("src"), F.struct("a", "b").alias("s")), "src").join(rest.select(F.col("node").alias("dst"), F.struct("a", "b").alias("t")), "dst")
        g = wide(own.filter("s = t").select("src", "dst"))
    out = left.join(known.hint("merge"), "node", "left") if known is not None else left.withColumn("component", F.col("node"))
    return out.select(F.col("node").alias("id"), F.coalesce("component", "node").alias("component"))


def cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Strong components of more than one node: (component, size)."""
    return strong_components(nodes, edges).groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level): rounds of taking away nodes without an edge in; null on or behind a cycle. By level and id it is a topological order."""
    left, g, level, out = cut(_ids(nodes)), cut(simple(nodes, edges)), 0, None
    while True:
        now = cut(left.join(g.select(F.col("dst").alias("node")), "node", "left_anti").withColumn("level", F.lit(level)))
        if now.isEmpty():
            break
        out = now if out is None else out.unionByName(now)
        left = cut(left.join(now, "node", "left_anti"))
        g = cut(g.join(now.select(F.col("node").alias("src")), "src", "left_anti"))
        level += 1
    rest = left.withColumn("level", F.lit(None).cast("int"))
    return (rest if out is None else out.unionByName(rest)).select(F.col("node").alias("id"), "level")


def is_dag(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row, is_dag: whether no two nodes are on a common cycle, loops aside; it takes the rounds that strong components take."""
    sizes = strong_components(nodes, edges).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg((F.coalesce(F.max("n"), F.lit(1)) == 1).alias("is_dag"))


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, centrality): edges in and out, parallel ones too, over n - 1."""
    ids = _ids(nodes)
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    others = max(ids.count() - 1, 1)
    return ids.join(ends, "node", "left").select(F.col("node").alias("id"), (F.coalesce("d", F.lit(0)) / others).alias("centrality"))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, clustering): directed edges among a node's neighbours (either direction, loops aside) over k(k - 1).

    Triangles are listed from their two smaller-degree ends, so a hub's neighbours are never paired.
    """
    ids, g = _ids(nodes), cut(simple(nodes, edges))
    ways = cut(both_ways(g))
    deg = cut(ways.groupBy("src").agg(F.count(F.lit(1)).alias("k")))
    pairs = ways.filter("src < dst").join(deg.withColumnRenamed("k", "ks"), "src").join(deg.select(F.col("src").alias("dst"), F.col("k").alias("kd")), "dst")
    up = F.struct("ks", "src") < F.struct("kd", "dst")
    ordered = cut(pairs.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("v")))
    fork = ordered.select("u", F.col("v").alias("a")).join(ordered.select("u", F.col("v").alias("b")), "u").filter("a < b")
    closed = fork.join(pairs.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"])
    corner = closed.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("a").alias("node"), F.least("u", "b").alias("x"), F.greatest("u", "b").alias("y")), F.struct(F.col("b").alias("node"), F.least("u", "a").alias("x"), F.greatest("u", "a").alias("y")))).alias("t")).select("t.*")
    weight = g.groupBy(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).agg(F.count(F.lit(1)).alias("w"))
    links = corner.join(weight, ["x", "y"]).groupBy("node").agg(F.sum("w").alias("links"))
    k = deg.select(F.col("src").alias("node"), "k")
    value = F.when(F.col("k") > 1, F.coalesce("links", F.lit(0)) / (F.col("k") * (F.col("k") - 1))).otherwise(0.0)
    return ids.join(k, "node", "left").join(links, "node", "left").select(F.col("node").alias("id"), F.coalesce(value, F.lit(0.0)).alias("clustering"))


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, community) by label propagation: each node takes its neighbours' most frequent label, the least of several.

    Nodes of even and odd id hash take turns, which keeps two halves from swapping labels for ever.
    """
    ways = cut(both_ways(simple(nodes, edges)))
    labels = cut(_ids(nodes).withColumn("label", F.col("node")))
    for turn in range(rounds):
        votes = ways.join(labels, F.col("dst") == F.col("node")).groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy(F.col("src").alias("node")).agg(F.min(F.struct((-F.col("n")).alias("n"), "label"))["label"].alias("best"))
        mine = F.pmod(F.xxhash64("node"), F.lit(2)) == turn % 2
        labels = cut(labels.join(best, "node", "left").select("node", F.when(mine, F.coalesce("best", "label")).otherwise(F.col("label")).alias("label")))
    return labels.select(F.col("node").alias("id"), F.col("label").alias("community"))


def louvain(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, levels: int = 10, rounds: int = 10) -> DataFrame:
    """(id, community) by local moves that raise modularity and contraction of communities, again and again (Blondel et al., 2008).

    In a round, half of the nodes (by hash, in turn) move to the neighbouring community of the greatest gain, the least of
    several; rounds of a level end when neither half raises the modularity, and its best state is kept. Then communities
    become nodes. Levels end when one changes nothing. Communities are named after their smallest id.
    """
    ways = wide(both_ways(simple(nodes, edges)).withColumn("w", F.lit(1.0)))
    total = ways.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    member = wide(_ids(nodes).withColumn("super", F.col("node")))
    for _ in range(levels if total else 0):
        degree = wide(ways.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")))
        best = state = wide(degree.select("node", "k", F.col("node").alias("label")))
        top, quiet = _quality(ways, state, total, resolution), 0
        start = top
        for turn in range(rounds):
            sums = state.groupBy("label").agg(F.sum("k").alias("tot"))
            own = state.select(F.col("node").alias("src"), F.col("label").alias("mine"), "k").join(sums.withColumnRenamed("label", "mine"), "mine")
            near = ways.filter("src <> dst").join(state.select(F.col("node").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.sum("w").alias("links"))
            gains = near.join(sums, "label").join(own.select("src", "mine", "k").hint("merge"), "src")
            gain = F.col("links") - resolution * F.col("k") * (F.col("tot") - F.when(F.col("label") == F.col("mine"), F.col("k")).otherwise(0.0)) / total
            scored = gains.select("src", "label", "mine", gain.alias("gain"))
            stay = scored.filter("label = mine").select("src", F.col("gain").alias("kept"))
            alone = own.select("src", (-resolution * F.col("k") * (F.col("tot") - F.col("k")) / total).alias("base"))
            pick = scored.groupBy("src").agg(F.min(F.struct((-F.round("gain", 9)).alias("g"), "label")).alias("p")).join(alone.hint("merge"), "src").join(stay.hint("merge"), "src", "left")
            moves = pick.filter(-F.col("p.g") > F.coalesce("kept", "base") + 1e-9).filter(F.pmod(F.xxhash64("src"), F.lit(2)) == turn % 2).select(F.col("src").alias("node"), F.col("p.label").alias("to"))
            state = wide(state.join(moves, "node", "left").select("node", "k", F.coalesce("to", "label").alias("label")))
            now = _quality(ways, state, total, resolution)
            best, top, quiet = (state, now, 0) if now > top + 1e-9 else (best, top, quiet + 1)
            if quiet == 2:
                break
        if top <= start + 1e-9:
            break
        to = best.select("node", "label")
        member = wide(member.join(to.withColumnRenamed("node", "super"), "super", "left").select("node", F.coalesce("label", "super").alias("super")))
        ends = ways.join(to.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(to.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst")
        ways = wide(ends.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")))
    names = member.groupBy("super").agg(F.min("node").alias("community"))
    return member.join(names, "super").select(F.col("node").alias("id"), "community")


def _quality(ways: DataFrame, state: DataFrame, total: float, resolution: float) -> float:
    """Modularity of state(node, k, label) on ways(src, dst, w), which has each edge both ways."""
    a, b = state.select(F.col("node").alias("src"), F.col("label").alias("a")), state.select(F.col("node").alias("dst"), F.col("label").alias("b"))
    inside = ways.join(a, "src").join(b, "dst").filter("a = b").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("inside"))
    spread = state.groupBy("label").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * F.col("t")).alias("spread"))
    r = inside.crossJoin(spread).first()  # single rows
    return r["inside"] / total - resolution * r["spread"] / total**2


def modularity(edges: DataFrame, communities: DataFrame, resolution: float = 1.0) -> DataFrame:
    """modularity of communities(id, community) on the undirected simple graph of edges."""
    pairs = edges.select(F.least("source_id", "target_id").alias("u"), F.greatest("source_id", "target_id").alias("v")).filter("u <> v").distinct()
    own = pairs.join(communities.select(F.col("id").alias("u"), F.col("community").alias("a")), "u").join(communities.select(F.col("id").alias("v"), F.col("community").alias("b")), "v")
    sides = own.select(F.explode(F.array(F.struct(F.col("a").alias("c"), (F.col("a") == F.col("b")).alias("same")), F.struct(F.col("b").alias("c"), F.lit(False).alias("same")))).alias("x")).select("x.*")
    each = sides.groupBy("c").agg(F.count(F.lit(1)).alias("deg"), F.count_if("same").alias("inside"))
    m = F.sum("deg") / 2
    return each.agg(F.round(F.sum("inside") / m - resolution * F.sum(F.col("deg") * F.col("deg")) / (4 * m * m), 8).alias("modularity"))


def metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n, m, average and largest degrees, density, strong components, largest one, is_dag; raw edges count, parallel ones too."""
    ids = _ids(nodes)
    outs = edges.groupBy(F.col("source_id").alias("node")).agg(F.count(F.lit(1)).alias("o"))
    ins = edges.groupBy(F.col("target_id").alias("node")).agg(F.count(F.lit(1)).alias("i"))
    d = ids.join(outs, "node", "left").join(ins, "node", "left").fillna(0, ["o", "i"])
    base = d.agg(F.count(F.lit(1)).alias("n"), F.sum("o").alias("m"), F.max("i").alias("max_in"), F.max("o").alias("max_out")).first()
    sizes = strong_components(nodes, edges).groupBy("component").count().agg(F.count(F.lit(1)).alias("c"), F.max("count").alias("largest")).first()
    n, m = base["n"], base["m"] or 0
    mean = round(m / n, 10) if n else 0.0  # as many ends as starts
    row = (n, m, mean, mean, base["max_in"], base["max_out"], round(m / (n * (n - 1)), 10) if n > 1 else 0.0, sizes["c"], sizes["largest"], sizes["c"] == n)
    return nodes.sparkSession.createDataFrame([row], "n long, m long, avg_in double, avg_out double, max_in long, max_out long, density double, n_scc long, largest_scc long, is_dag boolean")


def fans(nodes: DataFrame, edges: DataFrame, kinds: list[str]) -> DataFrame:
    """The nodes with raw counts of edges in and out of the given kinds: fan_in, fan_out."""
    some = edges.filter(F.col("kind").isin(kinds))
    ins = some.groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    outs = some.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("fan_out"))
    return nodes.join(ins, "id", "left").join(outs, "id", "left").fillna(0, ["fan_in", "fan_out"])


#: Fixed values: (role, least and most fan-in, least and most fan-out, exported or either), first fit counts; else utility.
ROLE_RULES = (
    ("dead", (0, 0), (0, None), False),
    ("entry", (0, 0), (1, None), None),
    ("entry", (0, None), (3, None), True),
    ("core", (5, None), (5, None), None),
    ("adapter", (0, 3), (5, None), None),
    ("utility", (1, 5), (1, 5), None),
    ("leaf", (1, None), (0, 2), None),
)


def role(fan_in: Column, fan_out: Column, exported: Column) -> Column:
    """The role that ROLE_RULES gives."""

    def within(x: Column, bounds: tuple) -> Column:
        low, high = bounds
        return (x >= low) if high is None else x.between(low, high)

    out = F.lit("utility")
    for name, i, o, e in reversed(ROLE_RULES):
        fits = within(fan_in, i) & within(fan_out, o)
        out = F.when(fits if e is None else fits & (exported == e), name).otherwise(out)
    return out


def risk(i: Column, exported: Column) -> Column:
    return F.when(i >= 10, "critical").when(exported | (i >= 5), "high").when(i > 0, "medium").otherwise("low")
