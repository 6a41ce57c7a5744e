"""Graph operators that need rounds: components, breadth-first searches, paths, subgraphs.

A round is a join and an aggregate on a frontier; its result is written to the shared folder, so plans stay short and
a lost executor costs one round. The driver sees counts only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..scratch import table


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of a small graph; the smaller root wins."""
    up: dict = {}

    def root(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for u, v in zip(*(c.to_pylist() for c in batch.columns)):
            u, v = root(u), root(v)
            if u != v:
                up[max(u, v)] = min(u, v)
    if kind is not None:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([root(x) for x in up], kind)], names=["node", "root"])


def components(edges: DataFrame, a: str = "a", b: str = "b", local: int = 0) -> DataFrame:
    """(node, root) of each node of an undirected graph; root is the smallest node of its component.

    Contraction: in each round a node joins the first of itself and its neighbours by an order that is another one each
    round, and links between joined nodes become links between what they joined, once each. A round is expected to leave
    two thirds of the nodes at most, so all rounds together move a few times what the first does, and the last GATHERED
    links are one task's work. Nodes without an edge to another are not listed. A graph of at most `local` edges is one task's work instead, which spares small ones the rounds. Nodes that
    aren't numbers are numbered first, so the rounds move numbers only.
    """
    if local:
        seen = Observation()
        edges = table(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges", seen, F.count(F.lit(1)).alias("n"))
        if seen.get["n"] <= local:
            kind = edges.schema["u"].dataType.simpleString()
            return edges.coalesce(1).mapInArrow(_union, f"node {kind}, root {kind}")
        a, b = "u", "v"
    if not isinstance(edges.schema[a].dataType, IntegralType) or not isinstance(edges.schema[b].dataType, IntegralType):
        return _named(edges, a, b)
    groups = _groups(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")))
    kind = edges.select(F.least(a, b).alias("x")).schema["x"].dataType
    return _rooted(groups.select(F.col("node").cast(kind).alias("node"), "level", "group"))


#: Links between contracted nodes that are one task's work, whatever the graph had.
GATHERED = 100_000


def _groups(edges: DataFrame) -> DataFrame:
    """(node, level, group): the component of each node of edges(u, v) of longs, by the round that left it alone and its number there."""
    seen, levels = Observation(), []
    now = table(edges.filter("u <> v"), "edges", seen, F.count(F.lit(1)).alias("n"))
    while seen.get["n"]:
        if seen.get["n"] <= GATHERED:
            levels.append(table(now.coalesce(1).mapInArrow(_union, "u long, m long"), "joined"))
            break
        # xxhash64 of one long maps longs one to one, so a new number is that of one node
        mark = lambda c: F.xxhash64(F.lit(len(levels)), F.col(c))  # noqa: B023, E731
        near = now.select("u", mark("v").alias("m")).unionByName(now.select(F.col("v").alias("u"), mark("u").alias("m")))
        joined = table(near.groupBy("u").agg(F.min("m").alias("m")).select("u", F.least("m", mark("u")).alias("m")), "joined")
        left, right = joined.select("u", F.col("m").alias("p")), joined.select(F.col("u").alias("v"), F.col("m").alias("q"))
        moved = now.join(left, "u").select("p", "v").join(right, "v").filter("p <> q")
        seen = Observation()
        now = table(moved.select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct(), "edges", seen, F.count(F.lit(1)).alias("n"))
        levels.append(joined)
    if not levels:
        return now.select(F.col("u").alias("node"), F.lit(0).alias("level"), F.col("v").alias("group"))
    found = None
    for level, joined in reversed(list(enumerate(levels, 1))):
        own = joined.select(F.col("u").alias("node"), F.col("m").alias("to"))
        if found is None:
            found = own.select("node", F.lit(level).alias("level"), F.col("to").alias("group"))
        else:
            up = own.join(found.withColumnRenamed("node", "to"), "to", "left")
            found = table(up.select("node", F.coalesce("level", F.lit(level)).alias("level"), F.coalesce("group", "to").alias("group")), "groups")
    return found


def _rooted(groups: DataFrame) -> DataFrame:
    least = groups.groupBy("level", "group").agg(F.min("node").alias("root"))
    return groups.join(least, ["level", "group"]).select("node", "root")


def _named(edges: DataFrame, a: str, b: str) -> DataFrame:
    """components() of nodes that aren't numbers, over numbers of them."""
    names, found = named_groups(edges, a, b)
    return _rooted(table(found.join(names.withColumnRenamed("id", "node"), "node").select(F.col("name").alias("node"), "level", "group"), "named"))


def named_groups(edges: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """(name, id) of the nodes with an edge to another, and (node, level, group) of their ids: a level and a group are a component."""
    pairs = table(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b"), "pairs")
    names = table(pairs.select(F.col("a").alias("name")).unionByName(pairs.select(F.col("b").alias("name"))).distinct().withColumn("id", F.monotonically_increasing_id()), "names")
    left, right = names.select(F.col("name").alias("a"), F.col("id").alias("u")), names.select(F.col("name").alias("b"), F.col("id").alias("v"))
    return names, _groups(pairs.join(left, "a").select("u", "b").join(right, "b").select("u", "v"))


def reach(steps: DataFrame, start: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth) of what lies within max_depth of start(node), along steps(source, target); depth is the least."""
    steps = steps.select("source", "target").filter("target is not null")
    if max_depth > 1:
        steps = table(steps, "steps")  # read in every round, made once
    found = table(start.select("node", F.lit(0).alias("depth")).distinct(), "reach")
    front = found
    for depth in range(1, max_depth + 1):
        new = front.join(steps, front["node"] == steps["source"]).select(F.col("target").alias("node")).distinct().join(found, "node", "left_anti")
        seen = Observation()
        front = table(new.select("node", F.lit(depth).alias("depth")), "front", seen, F.count(F.lit(1)).alias("n"))
        if not seen.get["n"]:
            break
        found = found.unionByName(front)
    return found


def both_ways(edges: DataFrame) -> DataFrame:
    one = edges.select("source", "target")
    return one.unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))


def neighbourhood(edges: DataFrame, anchor: str, depth: int) -> DataFrame:
    """(node, depth): all nodes within depth hops of anchor, whichever way the links point."""
    start = edges.sparkSession.createDataFrame([(anchor,)], "node string")
    return reach(both_ways(edges), start, depth)


def linked_within(edges: DataFrame, page: str, depth: int, backwards: bool = False) -> DataFrame:
    """(source, target, line, hop): links met by following them from page, or against them, for depth hops.

    A link that several predicates share is one row; hop is the least.
    """
    frm, to = ("target", "source") if backwards else ("source", "target")
    steps = edges.select(F.col(frm).alias("source"), F.col(to).alias("target"))
    start = edges.sparkSession.createDataFrame([(page,)], "node string")
    near = reach(steps, start, depth - 1) if depth > 1 else start.select("node", F.lit(0).alias("depth"))
    hits = edges.join(near, edges[frm] == near["node"]).select(edges["source"], edges["target"], "line", (F.col("depth") + 1).alias("hop"))
    return hits.groupBy("source", "target", "line").agg(F.min("hop").alias("hop"))


def shortest_path(edges: DataFrame, a: str, b: str, max_depth: int = 10) -> DataFrame:
    """(hops, path): one row if b can be reached from a along links within max_depth hops, else none.

    Of equally short paths, the one through the smallest names is given. The search keeps names and depths only; the
    path is then walked back from b, layer by layer, to what lies on any shortest path, and forth by the smallest name.
    """
    spark = edges.sparkSession
    if a == b:
        return spark.createDataFrame([(0, [a])], "hops int, path array<string>")
    steps = table(edges.select("source", "target").filter("target is not null").distinct(), "steps")
    layers = [table(spark.createDataFrame([(a,)], "node string"), "front")]
    met = layers[0]
    while len(layers) <= max_depth:
        new = layers[-1].join(steps, F.col("node") == F.col("source")).select(F.col("target").alias("node")).distinct().join(met, "node", "left_anti")
        seen = Observation()
        layers.append(table(new, "front", seen, F.count(F.lit(1)).alias("n"), F.count_if(F.col("node") == b).alias("hits")))
        if seen.get["hits"]:
            break
        if not seen.get["n"]:
            return spark.createDataFrame([], "hops int, path array<string>")
        met = met.unionByName(layers[-1])
    else:
        return spark.createDataFrame([], "hops int, path array<string>")
    on = [spark.createDataFrame([(b,)], "node string")]
    for layer in reversed(layers[1:-1]):
        to = steps.join(on[0].withColumnRenamed("node", "target"), "target", "left_semi").select(F.col("source").alias("node")).distinct()
        on.insert(0, table(layer.join(to, "node", "left_semi"), "on"))
    path = [a]
    for layer in on:
        nxt = steps.filter(F.col("source") == path[-1]).select(F.col("target").alias("node")).join(layer, "node", "left_semi")
        path.append(nxt.agg(F.min("node")).first()[0])
    return spark.createDataFrame([(len(path) - 1, path)], "hops int, path array<string>")


def induced(edges: DataFrame, near: DataFrame) -> DataFrame:
    """The edges whose two ends are among near(node)."""
    nodes = near.select("node").distinct()
    return edges.join(nodes.withColumnRenamed("node", "source"), "source", "left_semi").join(nodes.withColumnRenamed("node", "target"), "target", "left_semi")


#: Targets of one list in closure(), and pairs that one of its tasks groups, as far as no node has more.
LISTED, GROUPED = 1024, 2_000_000


def closure(steps: DataFrame, depth: int) -> DataFrame:
    """(source, target, hops) of all pairs within depth hops, hops at least 1: each node's reach at once.

    A node's pairs are its own steps and what the nodes that it steps to reach in a hop less. The reach of nodes that
    something steps to is packed into lists of LISTED names, less what all names of a list begin with, and sent by the
    list to the place of the source, where the pairs are made and grouped: pairs are neither shuffled nor written one by
    one. Steps move to their source once, to be told apart and marked, once by their target and once for themselves.
    """
    steps = steps.select("source", "target")
    if depth < 2:
        return steps.distinct().select("source", "target", F.lit(1).alias("hops"))
    met = steps.select(F.col("target").alias("source")).filter("source is not null").distinct().withColumn("met", F.lit(True))
    steps = table(steps.repartition("source").distinct().join(met, "source", "left"), "steps")
    inner, steps = table(steps.filter("met").select("source", "target"), "inner"), steps.select("source", "target")
    known, before = inner.select("source", "target", F.lit(1).alias("hops")), None
    for hop in range(2, depth + 1):
        seen = Observation()
        lists = table(_listed(known), "reach", seen, F.sum("n").alias("n"))
        if hop == depth or seen.get["n"] == before:  # nothing is further away
            break
        before = seen.get["n"]
        known = _one_more(inner, lists)
    return _one_more(steps, lists)


def _listed(known: DataFrame) -> DataFrame:
    """(via, hops, n, head, targets): known(source, target, hops) in lists of n names: what all of them begin with, and the rest of each as one text, which is half as long in a shuffle as an array."""
    at = F.row_number().over(Window.partitionBy("source").orderBy("hops", "target"))
    safe = F.coalesce(F.replace(F.replace("target", F.lit("\1"), F.lit("\1a")), F.lit("\0"), F.lit("\1b")), F.lit("\1n"))
    lists = known.withColumn("list", F.floor((at - 1) / LISTED)).groupBy(F.col("source").alias("via"), "hops", "list").agg(F.count("*").alias("n"), F.collect_list(safe).alias("names"))
    lists = lists.withColumns({"low": F.array_min("names"), "high": F.array_max("names")}).withColumn("most", F.least(F.length("low"), F.length("high")))
    other = F.array_position(F.transform(F.sequence(F.lit(1), F.col("most")), lambda i: F.substring(F.col("low"), i, F.lit(1)) != F.substring(F.col("high"), i, F.lit(1))), True)
    # names with marks stay whole
    whole = (F.col("most") == 0) | F.exists("names", lambda t: t.contains("\1"))
    lists = lists.withColumn("k", F.when(whole, 0).when(other > 0, other - 1).otherwise(F.col("most")).cast("int"))
    rest = F.transform("names", lambda t: F.substring(t, F.col("k") + 1, F.length(t)))
    return lists.select("via", "hops", "n", F.substring(F.col("low"), F.lit(1), F.col("k")).alias("head"), F.array_join(F.when(F.col("k") > 0, rest).otherwise(F.col("names")), "\0").alias("targets"))


def _unlisted(targets: Column) -> Column:
    name = lambda t: F.when(t != "\1n", F.replace(F.replace(t, F.lit("\1b"), F.lit("\0")), F.lit("\1a"), F.lit("\1")))
    every = F.split(targets, "\0")
    return F.when(targets.contains("\1"), F.transform(every, name)).otherwise(every)


def _one_more(steps: DataFrame, lists: DataFrame) -> DataFrame:
    """(source, target, hops) of steps and of what lists(via, hops, n, head, targets) say of their targets."""
    sizes = lists.groupBy("via").agg(F.sum("n").alias("n"))
    pairs = steps.groupBy(F.col("target").alias("via")).agg(F.count("*").alias("k")).join(sizes, "via").agg(F.sum(F.col("k") * F.col("n"))).first()[0] or 0
    places = max(int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // GROUPED))
    own = steps.select("source", F.lit(1).alias("hops"), F.lit(None).cast("string").alias("head"), F.col("target").alias("targets"))
    led = steps.withColumnRenamed("target", "via").join(lists, "via").select("source", (F.col("hops") + 1).alias("hops"), "head", "targets")
    sent = own.unionByName(led).repartition(places, "source")
    own = F.col("head").isNull()
    each = sent.select("source", "hops", "head", F.explode(F.when(own, F.array("targets")).otherwise(_unlisted(F.col("targets")))).alias("rest"))
    return each.select("source", "hops", F.when(own, F.col("rest")).otherwise(F.concat("head", "rest")).alias("target")).groupBy("source", "target").agg(F.min("hops").alias("hops"))
