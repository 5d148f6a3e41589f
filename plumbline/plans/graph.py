"""Graph searches over numbered nodes: reach, strongly connected components, the condensation, and set sizes by sketches.

Names become 64-bit numbers once, so that rounds hash and compare integers. Every round is a table in the shared folder: plans stay
short, a lost executor costs one round, and the number of new rows comes from the write itself instead of from a second job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from plumbline.session import work_path

#: Propagation steps in one job: more of them save jobs, fewer save steps after the last change.
STEPS = 8
#: Labellings that are spread together.
LABELS = 4
#: Registers of a sketch are 2 ** LG_K: a standard error of about 1.6 %, exact for small sets.
LG_K = 12


class Rounds:
    """Tables of one search, stored one after another below one folder."""

    def __init__(self, spark, what: str):
        self.spark, self.root, self.paths = spark, work_path(spark, what), []

    def add(self, df: DataFrame, *counters) -> tuple[DataFrame, dict]:
        """Stores one table; returns it with its row count ``n`` and the further aggregates asked for."""
        path, seen = f"{self.root}/{len(self.paths)}", Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n"), *counters).write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path), {"n": 0} | seen.get

    def all(self, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*self.paths)


@dataclass(frozen=True)
class Numbered:
    """``nodes``: node, id. ``edges``: src, dst as ids, without repeats."""

    nodes: DataFrame
    edges: DataFrame


def number(edges: DataFrame) -> Numbered:
    """Numbers the nodes of (src, dst) in the order of their names within hash partitions."""
    rounds = Rounds(edges.sparkSession, "graph")
    nodes, _ = rounds.add(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().sortWithinPartitions("node").withColumn(
        "id", F.monotonically_increasing_id()))
    source, target = nodes.select(F.col("node").alias("src"), F.col("id").alias("s")), nodes.select(F.col("node").alias("dst"), F.col("id").alias("d"))
    pairs = edges.select("src", "dst").join(source, "src").join(target, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct()
    return Numbered(nodes, rounds.add(pairs)[0])


def spread(edges: DataFrame, roots: DataFrame, depth: int | None) -> DataFrame:
    """(root, node, hop) from every ``root``, itself at hop 0, to the nodes within ``depth`` hops; nodes as they are named in ``edges``."""
    rounds = Rounds(edges.sparkSession, "reach")
    newest, seen = rounds.add(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("hop")).distinct())
    steps = edges.withColumnRenamed("src", "node")
    hop = 0
    while seen["n"] and (depth is None or hop < depth):
        hop += 1
        step = newest.join(steps, "node").select("root", F.col("dst").alias("node")).distinct()
        fresh = step.join(rounds.all(newest.schema).select("root", "node"), ["root", "node"], "left_anti")
        newest, seen = rounds.add(fresh.withColumn("hop", F.lit(hop)).select("root", "node", "hop"))
    return rounds.all(newest.schema)


def trim(edges: DataFrame) -> DataFrame:
    """Stored edges without those from nodes that nothing leads to, or to nodes that lead nowhere; such edges lie on no cycle.

    Taking them bares others, so it goes on, two peels a round, while a round takes at least a tenth of the edges: all rounds together then
    read ten times the edges at most, and a long chain that loses little in each is left to the colours.
    """
    rounds = Rounds(edges.sparkSession, "trim")
    left, seen = rounds.add(_peel(_peel(edges)))
    while seen["n"]:
        before = seen["n"]
        left, seen = rounds.add(_peel(_peel(left)))
        if seen["n"] > 0.9 * before:
            break
    return left


def _peel(edges: DataFrame) -> DataFrame:
    fed, feeding = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
    return edges.join(fed, "src", "left_semi").join(feeding, "dst", "left_semi").select("src", "dst")


def classes(edges: DataFrame, turn: int = 0) -> tuple[DataFrame, dict]:
    """(node, class, component): stored, with counts ``n`` and ``settled``. Nodes of one strongly connected component share their class.

    Forward and backward colours spread along the edges at once: ``f`` is the smallest label that reaches a node, ``b`` the
    smallest that it reaches. Where both are one node's label, the node lies on a cycle with that node, which settles its ``component``. All
    nodes of a component share both colours. Several labellings run at once: nodes of different components agree in all of them only
    if nearly the same nodes reach them and are reached. Labels are scattered, so names in the order of a chain do no harm. Steps follow
    the longest path, not the number of nodes.
    """
    colours, names = _colours(edges, turn)
    settled = F.coalesce(*[F.when(F.col(f"f{k}") == F.col(f"b{k}"), F.struct(F.lit(turn).alias("turn"), F.lit(k).alias("k"), F.col(f"f{k}").alias("label"))) for k in range(LABELS)])
    return Rounds(edges.sparkSession, "classes").add(
        colours.select("node", F.struct(*names).alias("class"), settled.alias("component")), F.count("component").alias("settled"))


def within(edges: DataFrame, marked: DataFrame, mark: str) -> DataFrame:
    """(src, dst) of the edges whose ends have the same value of ``mark``."""
    own, other = marked.select(F.col("node").alias("src"), F.col(mark).alias("__a")), marked.select(F.col("node").alias("dst"), F.col(mark).alias("__b"))
    return edges.join(own, "src").join(other, "dst").where("__a = __b").select("src", "dst")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component, size) of the nodes that lie on cycles: on longer ones together, or on a loop of one edge.

    Edges between unlike classes go, and so do settled nodes; what is left is trimmed and coloured again under fresh labels. Each
    turn settles at least the node with the smallest label of each class.
    """
    core, groups, turn = trim(edges.select("src", "dst")), None, 0
    while True:
        marked, seen = classes(core, turn)
        found = marked.where("component IS NOT NULL").select("node", "component")
        groups = found if groups is None else groups.union(found)
        if seen["n"] == seen["settled"]:
            break
        core = trim(within(core, marked.where("component IS NULL"), "class"))
        turn += 1
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct().withColumn("loop", F.lit(True))
    sizes = groups.groupBy("component").agg(F.count("*").alias("size"), F.min("node").alias("first"))
    named = groups.join(sizes, "component").join(loops, "node", "left").where("size > 1 OR loop")
    return named.select("node", F.col("first").alias("component"), "size")


def _scattered(node: Column, salt: int) -> Column:
    """A permutation of the 64-bit numbers, another one for each salt: shifts and exclusive ors lose nothing."""
    mixed = node.bitwiseXOR(F.lit((salt + 1) * 0x1E3779B97F4A7C15 % (1 << 63)))
    for left, count in ((True, 13), (False, 7), (True, 17)):
        mixed = mixed.bitwiseXOR(F.shiftleft(mixed, count) if left else F.shiftrightunsigned(mixed, count))
    return mixed


def _colours(core: DataFrame, turn: int) -> tuple[DataFrame, list[str]]:
    """(node, f0.., b0..): smallest labels up and down the edges of ``core`` under ``LABELS`` labellings, and the names of these columns."""
    rounds = Rounds(core.sparkSession, "colours")
    fore, back = [f"f{k}" for k in range(LABELS)], [f"b{k}" for k in range(LABELS)]
    both = [*fore, *back]
    nodes = core.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    state = nodes.select("node", *[_scattered(F.col("node"), turn * LABELS + k).alias(c) for names in (fore, back) for k, c in enumerate(names)])
    # a node keeps its own colours, hands the forward ones to its successors and the backward ones to its predecessors
    ways = core.select("src", F.col("dst").alias("to"), F.lit(1).alias("way")).unionByName(
        core.select(F.col("dst").alias("src"), F.col("src").alias("to"), F.lit(-1).alias("way"))).unionByName(
        nodes.select(F.col("node").alias("src"), F.col("node").alias("to"), F.lit(0).alias("way")))
    ways, _ = rounds.add(ways)
    total = F.sum(sum((F.col(c).cast("decimal(38,0)") for c in both[1:]), F.col(both[0]).cast("decimal(38,0)"))).alias("total")
    sent = [F.col("to").alias("node"), *[F.when(F.col("way") >= 0, F.col(c)).alias(c) for c in fore], *[F.when(F.col("way") <= 0, F.col(c)).alias(c) for c in back]]
    lowest = [F.min(c).alias(c) for c in both]
    while True:
        for step in range(STEPS):
            if step == STEPS - 1:
                late = Observation()
                state = state.observe(late, total)
            state = state.withColumnRenamed("node", "src").join(ways, "src").select(*sent).groupBy("node").agg(*lowest)
        state, seen = rounds.add(state, total)
        # labels only ever fall, so an equal sum says that none moved in the last step
        if not seen["n"] or seen["total"] == late.get.get("total"):
            return state, both


@dataclass(frozen=True)
class Condensed:
    """``members``: node, group for every node; a group is a component, or one node on no cycle. ``edges``: src, dst between groups, free of cycles."""

    members: DataFrame
    edges: DataFrame


def condense(graph: Numbered) -> Condensed:
    """Each strongly connected component becomes one node, so closures are searched on a graph without cycles."""
    rounds = Rounds(graph.edges.sparkSession, "condensed")
    groups = strong_components(graph.edges).select(F.col("node").alias("id"), "component")
    members, _ = rounds.add(graph.nodes.select("id").join(groups, "id", "left").select(F.col("id").alias("node"), F.coalesce("component", "id").alias("group")))
    source, target = members.select(F.col("node").alias("src"), F.col("group").alias("a")), members.select(F.col("node").alias("dst"), F.col("group").alias("b"))
    between = graph.edges.join(source, "src").join(target, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    return Condensed(members, rounds.add(between)[0])


def closure(graph: Numbered, roots: DataFrame) -> DataFrame:
    """(root, node) for every other node that a root reaches, by any number of hops; ``roots``: root, an id.

    Roots of one component share one search, and its members are put in at the end.
    """
    small = condense(graph)
    starts = roots.select(F.col("root").alias("node")).distinct().join(small.members, "node").select(F.col("node").alias("root"), "group")
    reached = spread(small.edges, starts.select(F.col("group").alias("root")), None).select(F.col("root").alias("from"), F.col("node").alias("group"))
    pairs = starts.withColumnRenamed("group", "from").join(reached, "from").join(small.members, "group").select("root", "node")
    return pairs.where("root <> node")


def sketch_spread(edges: DataFrame, nodes: DataFrame, depth: int, lg_k: int = LG_K) -> DataFrame:
    """(way, node, reached, last_hop): about how many other nodes each node reaches within ``depth`` hops, and the last hop with news.

    Both ways are searched at once: ``down`` along the edges, ``up`` against them. Each round passes the sketches of successors to a node and
    merges them with its own; a sketch that the round before left as it was has been passed already and stays, and a node that nothing
    comes to merges nothing. So a round costs one row a node and one message for each edge from a changed node, whatever the sets hold: at
    most depth times (nodes + edges) instead of nodes squared. Counts are exact while a set is small and off by about 1.04 / sqrt(2 ** lg_k) beyond. A hop counts as news if the
    estimate grew, so a hop that adds little to a large set can be missed.
    """
    rounds = Rounds(edges.sparkSession, "sketches")
    ways = F.explode(F.array(F.lit("down"), F.lit("up"))).alias("way")
    held, seen = rounds.add(nodes.select(ways, F.col("id").alias("node"), F.col("id").alias("member")).groupBy("way", "node").agg(
        F.hll_sketch_agg("member", lg_k).alias("sketch")).select("way", "node", "sketch", F.lit(1).cast("long").alias("size"), F.lit(0).alias("last_hop"), F.lit(True).alias("fresh")))
    back = edges.select(F.lit("down").alias("way"), F.col("dst").alias("node"), F.col("src").alias("to")).unionByName(
        edges.select(F.lit("up").alias("way"), F.col("src").alias("node"), F.col("dst").alias("to"))).where("node <> to")
    back, _ = Rounds(edges.sparkSession, "ways").add(back)
    key = ["way", "node"]
    for hop in range(1, depth + 1):
        came = held.where("fresh").join(back, key).groupBy("way", F.col("to").alias("node")).agg(F.hll_union_agg("sketch").alias("came"))
        merged = held.join(came, key, "left").withColumn("union", F.when(F.col("came").isNotNull(), F.hll_union("sketch", "came")))
        changed = F.coalesce(F.col("union") != F.col("sketch"), F.lit(False))
        grown = merged.withColumn("fresh", changed).withColumn("found", F.when(F.col("fresh"), F.hll_sketch_estimate("union")))
        news = F.coalesce(F.col("found") > F.col("size"), F.lit(False))
        held, seen = rounds.add(grown.select(
            "way", "node", F.coalesce("union", "sketch").alias("sketch"), F.greatest("size", "found").alias("size"), F.when(news, F.lit(hop)).otherwise(F.col("last_hop")).alias("last_hop"),
            "fresh", news.alias("news")), F.sum(F.col("news").cast("long")).alias("news"))
        held = held.drop("news")
        if not seen["news"]:
            break
    return held.select("way", "node", (F.col("size") - 1).alias("reached"), "last_hop")
