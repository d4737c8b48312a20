"""Graph operators over edge tables: components, taint, reach, paths, cycles, distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.shared import Staged


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 64) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node that can be reached.

    Contraction: each round gives the nodes a new random order, maps a node to the first one next to it or
    itself, relabels the edges and drops loops, so long chains shrink by a share each round, and the edge
    table until it is empty; the maps are then composed from the last to the first. Every round is an
    aggregate and two joins against a written table, so a hub node is combined before the shuffle and
    adaptive execution may split its join partition. Rows with a null end are ignored.
    """
    spark = edges.sparkSession
    kind = edges.schema[src].dataType
    edge = Staged(
        edges.select(F.col(src).alias("a"), F.col(dst).cast(kind).alias("b")).where("a is not null and b is not null and a <> b").distinct(),
        "edges",
    )
    maps: list[Staged] = []
    for turn in range(max_rounds):
        if edge.df.isEmpty():
            break
        placed = lambda c, t=turn: F.struct(F.xxhash64(c, F.lit(t)).alias("place"), F.col(c).alias("node"))
        both = edge.df.unionByName(edge.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(placed("b")).alias("first"))
        step = Staged(first.select(F.col("a").alias("node"), F.least("first", placed("a"))["node"].alias("up")), "hook")
        maps.append(step)
        left = step.df.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        right = step.df.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        nxt = Staged(
            edge.df.join(left, "a").join(right, "b").where("ua <> ub").select(F.col("ua").alias("a"), F.col("ub").alias("b")).distinct(),
            "edges",
        )
        edge.drop()
        edge = nxt
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    edge.drop()
    if not maps:
        return spark.createDataFrame([], f"node {kind.simpleString()}, component {kind.simpleString()}")
    done = maps[-1].df.select("node", F.col("up").alias("root"))
    used = list(maps)
    for step in reversed(maps[:-1]):
        # a hub is the target of many nodes: the deeper map is written so that this join can be split
        known = Staged(done.select(F.col("node").alias("up"), "root"), "known")
        used.append(known)
        done = step.df.join(known.df, "up", "left").select("node", F.coalesce("root", "up").alias("root"))
    done = Staged(done, "roots").df
    for table in used:
        table.drop()
    return done.join(done.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")


def tainted(nodes: DataFrame, components: DataFrame, node: str, exposed: str) -> DataFrame:
    """nodes with status: exposed itself, related (another node of its component is) or clean."""
    member = nodes.join(components.withColumnRenamed("node", node), node, "left").withColumn("component", F.coalesce("component", node))
    any_exposed = member.groupBy("component").agg(F.bool_or(exposed).alias("__any"))
    status = F.when(F.col(exposed), "exposed").when(F.col("__any"), "related").otherwise("clean")
    return member.join(any_exposed, "component").withColumn("status", status).drop("__any")


def distances(edges: DataFrame, sources: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """(node, depth): the least number of edges (src, dst) from any source node.

    Breadth first: each round is a join of the frontier with the edges and an anti join with what is
    known, against written tables; the reached table is appended to, never recomputed.
    """
    kind = edges.schema["src"].dataType
    frontier = Staged(sources.select(F.col(sources.columns[0]).cast(kind).alias("node")).distinct().withColumn("depth", F.lit(0)), "frontier")
    found = [frontier.df]
    for depth in range(1, max_depth + 1):
        seen = found[0]
        for part in found[1:]:
            seen = seen.unionByName(part)
        step = edges.join(frontier.df.select(F.col("node").alias("src")), "src").select(F.col("dst").cast(kind).alias("node")).distinct()
        frontier = Staged(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.df.isEmpty():
            return seen
        found.append(frontier.df)
    raise RuntimeError(f"more than {max_depth} levels")


def _leading(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """The distinct edges (src, dst) from which a target can be reached, written: no path to one has others.

    All edges are shuffled once and then read once for each step back from the targets.
    """
    edge = Staged(edges.select("src", "dst").distinct(), "edges")
    useful = distances(edge.df.select(F.col("dst").alias("src"), F.col("src").alias("dst")), targets.select(targets.columns[0])).select(F.col("node").alias("__useful"))
    kept = Staged(edge.df.join(useful, F.col("dst") == F.col("__useful"), "left_semi"), "leading").df
    edge.drop()
    return kept


def simple_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_paths: int = 100_000) -> DataFrame:
    """(path, length): all paths without a repeated node from a source to a target, however long.

    Only edges from which a target can be reached are followed, a longer step in each round, until no path grows. The
    number of paths can be exponential in a graph: ValueError if more than max_paths grow at once or are found, and never
    a part of them. path_counts() counts without listing, and first_paths() lists the first few.
    """
    src, dst = F.col("src"), F.col("dst")
    ends = targets.select(F.col(targets.columns[0]).alias("__end")).distinct()
    edge = _leading(edges, ends)
    live = Staged(sources.select(F.array(F.col(sources.columns[0])).alias("path")).distinct(), "paths").df
    done, found = None, 0
    while True:
        hit = live.join(ends, F.element_at("path", -1) == F.col("__end"), "left_semi")
        done = hit if done is None else done.unionByName(hit)
        found += hit.count()
        grown = live.join(edge, F.element_at("path", -1) == src).where(~F.array_contains("path", dst))
        live = Staged(grown.select(F.concat("path", F.array(dst)).alias("path")), "paths").df
        alive = live.count()
        if max(found, alive) > max_paths:
            raise ValueError(f"more than {max_paths} paths")
        if not alive:
            return done.select("path", (F.size("path") - 1).cast("long").alias("length"))


def _acyclic(edges: DataFrame) -> None:
    if not on_cycles(edges).isEmpty():
        raise ValueError("the edges have a cycle")


def path_counts(edges: DataFrame, sources: DataFrame, targets: DataFrame, mediators: DataFrame) -> DataFrame:
    """(node, paths, mediated): for each target that is reached, how many paths lead to it from the sources, and how many of them hold a mediator.

    Counts by dynamic programming over the edges that lead to a target, one round for each length: nodes, and never paths, are
    rows, so a graph with 10^30 paths is no more work than one with few. Numbers are decimals of 38 digits; sources and targets
    count among a path's nodes. ValueError if the edges that lead to a target have a cycle.
    """
    edge = _leading(edges, targets)
    _acyclic(edge)
    return _path_counts(edge, sources, targets, mediators)


def _path_counts(edge: DataFrame, sources: DataFrame, targets: DataFrame, mediators: DataFrame) -> DataFrame:
    """path_counts() over written edges without a cycle."""
    stop = mediators.select(F.col(mediators.columns[0]).alias("node")).distinct().withColumn("__stop", F.lit(True))
    number = lambda x: x.cast("decimal(38,0)")
    # of the paths to a node those without a mediator end where the node is one
    through = lambda df: df.join(stop, "node", "left").withColumn("clear", F.when(F.col("__stop"), number(F.lit(0))).otherwise(F.col("clear"))).drop("__stop")
    one = sources.select(F.col(sources.columns[0]).cast(edge.schema["src"].dataType).alias("node")).distinct()
    live = Staged(through(one.withColumns({"paths": number(F.lit(1)), "clear": number(F.lit(1))})), "counts").df
    ends = targets.select(F.col(targets.columns[0]).alias("node")).distinct()
    done = None
    while not live.isEmpty():
        hit = live.join(ends, "node", "left_semi")
        done = hit if done is None else done.unionByName(hit)
        step = live.withColumnRenamed("node", "src").join(edge, "src").groupBy(F.col("dst").alias("node")).agg(number(F.sum("paths")).alias("paths"), number(F.sum("clear")).alias("clear"))
        live = Staged(through(step), "counts").df
    if done is None:
        return ends.limit(0).select("node", number(F.lit(0)).alias("paths"), number(F.lit(0)).alias("mediated"))
    total = done.groupBy("node").agg(number(F.sum("paths")).alias("paths"), number(F.sum("clear")).alias("clear"))
    return total.select("node", "paths", number(F.col("paths") - F.col("clear")).alias("mediated"))


def first_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, k: int = 1) -> DataFrame:
    """(node, rank, path): for each target the k first paths from a source, by length and then by their nodes in order.

    Grown on demand over the edges that lead to a target: each round keeps k paths of its length for each node, as the first paths to a
    node pass through first paths of one edge less, and the rounds end when all targets have k or nothing grows. ValueError
    if the edges that lead to a target have a cycle.
    """
    edge = _leading(edges, targets)
    _acyclic(edge)
    return _first_paths(edge, sources, targets, k)


def _first_paths(edge: DataFrame, sources: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """first_paths() over written edges without a cycle."""
    kind = edge.schema["src"].dataType
    rank = lambda by: F.row_number().over(Window.partitionBy("node").orderBy(*by))
    ends = targets.select(F.col(targets.columns[0]).cast(kind).alias("node")).distinct()
    source = F.col(sources.columns[0]).cast(kind)
    live = Staged(sources.select(source.alias("node"), F.array(source).alias("path")).distinct(), "first").df
    done = None
    while not live.isEmpty():
        hit = live.join(ends, "node", "left_semi")
        done = hit if done is None else done.unionByName(hit)
        full = done.groupBy("node").count().where(F.col("count") >= k)
        if ends.join(full, "node", "left_anti").isEmpty():
            break
        step = live.withColumnRenamed("node", "src").join(edge, "src").select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        live = Staged(step.withColumn("rank", rank(["path"])).where(F.col("rank") <= k).drop("rank"), "first").df
    if done is None:
        return ends.limit(0).select("node", F.lit(1).alias("rank"), F.array("node").alias("path"))
    return done.withColumn("rank", rank([F.size("path"), "path"])).where(F.col("rank") <= k).select("node", "rank", "path")


def on_cycles(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(node) of the nodes left when nodes without an incoming or without an outgoing edge are taken away again and
    again; empty exactly if there is no cycle."""
    edge = Staged(edges.select("src", "dst").distinct(), "edges")
    for _ in range(max_rounds):
        before = edge.df.count()
        kept = edge.df.join(edge.df.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edge.df.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        edge = Staged(kept, "edges")
        after = edge.df.count()
        if after == before or after == 0:
            return edge.df.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    raise RuntimeError("trimming did not settle")


def invalid_edges(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """(src, dst, reason): dangling ends, loops and repeated edges."""
    ids = nodes.select(F.col(node).alias("__id")).distinct()
    known = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    known = known.join(ids.withColumnRenamed("__id", "src").withColumn("has_src", F.lit(True)), "src", "left").join(ids.withColumnRenamed("__id", "dst").withColumn("has_dst", F.lit(True)), "dst", "left")
    reason = F.when(F.col("has_src").isNull(), "dangling_source").when(F.col("has_dst").isNull(), "dangling_target").when(F.col("src") == F.col("dst"), "loop").when(F.col("n") > 1, "repeated")
    return known.select("src", "dst", reason.alias("reason")).where("reason is not null")


def shortest_uncovered(edges: DataFrame, sources: DataFrame, targets: DataFrame, covering: DataFrame) -> DataFrame:
    """(node, paths, uncovered, counterexample): the paths to each target, those that hold no covering node, and the first of them by length and nodes, or null.

    ValueError if the edges that lead to a target have a cycle.
    """
    edge = _leading(edges, targets)
    _acyclic(edge)
    counts = _path_counts(edge, sources, targets, covering)
    bare = covering.select(F.col(covering.columns[0]).alias("__c")).distinct()
    off = lambda df, c: df.join(bare, F.col(c) == F.col("__c"), "left_anti")
    clear = Staged(off(off(edge, "src"), "dst"), "clear").df
    first = _first_paths(clear, off(sources, sources.columns[0]), off(targets, targets.columns[0]), 1)
    out = counts.join(first.select("node", F.col("path").alias("counterexample")), "node", "left")
    return out.select("node", "paths", (F.col("paths") - F.col("mediated")).cast("decimal(38,0)").alias("uncovered"), "counterexample")


def closure(edges: DataFrame, marks: DataFrame, mark: str, max_depth: int = 10_000) -> DataFrame:
    """(node, mark, depth): the marks (node, mark) that each node reaches along edges (src, dst), with the least number of steps.

    Marks travel against the edges, only new pairs of node and mark in each round; every round is a join of the last round's
    pairs with the edges and an anti join with all found, against written tables.
    """
    kind = edges.schema["src"].dataType
    back = edges.select("src", F.col("dst").alias("node")).distinct()
    fresh = Staged(marks.select(F.col("node").cast(kind).alias("node"), mark).distinct().withColumn("depth", F.lit(0)), "marks")
    found = [fresh.df]
    for depth in range(1, max_depth + 1):
        known = found[0]
        for part in found[1:]:
            known = known.unionByName(part)
        step = back.join(fresh.df.select("node", mark), "node").select(F.col("src").alias("node"), mark).distinct()
        fresh = Staged(step.join(known.select("node", mark), ["node", mark], "left_anti").withColumn("depth", F.lit(depth)), "marks")
        if fresh.df.isEmpty():
            return known
        found.append(fresh.df)
    raise RuntimeError(f"more than {max_depth} levels")


def chains(edges: DataFrame, roots: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """(root, node, chain): every node that a root reaches, with the first of its shortest chains of nodes in array order."""
    kind = edges.schema["src"].dataType
    root = F.col(roots.columns[0]).cast(kind)
    fresh = Staged(roots.select(root.alias("root"), root.alias("node"), F.array(root).alias("chain")).distinct(), "chains")
    found = [fresh.df]
    for _ in range(max_depth):
        known = found[0]
        for part in found[1:]:
            known = known.unionByName(part)
        step = fresh.df.join(edges.select(F.col("src").alias("node"), "dst").distinct(), "node").select("root", F.col("dst").alias("node"), F.concat("chain", F.array("dst")).alias("chain"))
        step = step.groupBy("root", "node").agg(F.min("chain").alias("chain"))
        fresh = Staged(step.join(known.select("root", "node"), ["root", "node"], "left_anti"), "chains")
        if fresh.df.isEmpty():
            return known
        found.append(fresh.df)
    raise RuntimeError(f"more than {max_depth} levels")
