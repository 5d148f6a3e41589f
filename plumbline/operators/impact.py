"""Upstream and downstream reach over a lineage graph.

All searches are breadth-first loops over DataFrames that serve every root at once: one join of
the frontier with the edges per hop, each hop a stored table (``plans/graph.py``). Searches without a
bound on their depth go over the condensation, and cycles are searched inside components only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as fixed
from plumbline.plans import graph
from plumbline.session import cut_lineage


def active_edges(edges_df: DataFrame) -> DataFrame:
    """(src, dst, n_edges) of the active edges, parallel ones folded into a count."""
    return edges_df.filter("is_active").groupBy(
        F.col("source_table_id").alias("src"), F.col("target_table_id").alias("dst")
    ).agg(F.count(F.lit(1)).alias("n_edges"))


def _turned(edges: DataFrame, direction: str) -> DataFrame:
    """(src, dst) along ``down``, against the edges for ``up``."""
    return edges.select("src", "dst") if direction == "down" else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _from_root(edges_df: DataFrame, root: str, depth: int, direction: str) -> DataFrame:
    roots = edges_df.sparkSession.createDataFrame([(root,)], "root string")
    return graph.spread(_turned(active_edges(edges_df), direction), roots, depth).filter("hop > 0")


def downstream(edges_df: DataFrame, root: str, depth: int = 5) -> DataFrame:
    """(root, node, hop) of the tables fed by ``root``."""
    return _from_root(edges_df, root, depth, "down")


def upstream(edges_df: DataFrame, root: str, depth: int = 5) -> DataFrame:
    """(root, node, hop) of the tables ``root`` is made from."""
    return _from_root(edges_df, root, depth, "up")


def _ids(numbered: graph.Numbered, names: DataFrame) -> DataFrame:
    """(root) as ids for a ``root`` column of names; names outside the graph have none."""
    return names.select(F.col("root").alias("node")).distinct().join(numbered.nodes, "node").select(F.col("id").alias("root"))


def _fan(numbered: graph.Numbered, edges: DataFrame, column: str) -> DataFrame:
    """(id, k): parallel edges included, how many edges have a node in ``column``."""
    named = edges.groupBy(F.col(column).alias("node")).agg(F.sum("n_edges").alias("k"))
    return named.join(numbered.nodes, "node").select("id", "k")


def risk_level(direct, indirect, depth):
    total = direct + indirect
    return (
        F.when(total == 0, "LOW")
        .when((depth <= 2) & (total <= 5), "LOW")
        .when((depth <= 3) & (total <= 10), "MEDIUM")
        .when((depth <= 5) & (total <= 20), "HIGH")
        .otherwise("CRITICAL")
    )


def blast_radius(
    edges_df: DataFrame, roots: DataFrame | None = None, depth: int = 10, compat: bool = False
) -> DataFrame:
    """What breaks when a table goes, for every table (or the ``root`` column of ``roots``).

    direct and indirect are distinct tables at one and at more hops. ``compat`` counts edges
    instead, those leaving hop-1 nodes as direct and those of deeper hops as indirect.
    Pairs of tables are listed on the way; :func:`blast_radius_sketched` avoids that.
    """
    edges = cut_lineage(active_edges(edges_df))
    numbered = graph.number(edges)
    if roots is None:
        # from everywhere, what is upstream of a table is what has it downstream
        below = graph.spread(numbered.edges, numbered.nodes.select(F.col("id").alias("root")), depth)
        above = below.select(F.col("node").alias("root"), F.col("root").alias("node"), "hop")
    else:
        starts = _ids(numbered, roots)
        below, above = (graph.spread(_turned(numbered.edges, way), starts, depth) for way in ("down", "up"))
    hop = F.col("hop")
    if compat:
        below = below.join(_fan(numbered, edges, "src").withColumnRenamed("id", "node"), "node", "left")
        above = above.join(_fan(numbered, edges, "dst").withColumnRenamed("id", "node"), "node", "left")
        weight, counted = F.coalesce("k", F.lit(0)), hop >= 0
    else:
        weight, counted = F.lit(1), hop > 0
    down = below.groupBy("root").agg(
        F.sum(F.when(hop == 1, weight).otherwise(0)).alias("direct"), F.sum(F.when(hop > 1, weight).otherwise(0)).alias("indirect"), F.max("hop").alias("max_depth"))
    up = above.groupBy("root").agg(F.sum(F.when(counted, weight).otherwise(0)).alias("data_sources"))
    return _verdicts(numbered, down.join(up, "root"))


def _verdicts(numbered: graph.Numbered, counts: DataFrame) -> DataFrame:
    named = counts.join(numbered.nodes.select(F.col("id").alias("root"), "node"), "root")
    return named.select(
        F.col("node").alias("root"), "direct", "indirect", (F.col("direct") + F.col("indirect")).alias("total"), "max_depth",
        (F.col("direct") * 5 + F.col("indirect") * 2).alias("affected_queries"), "data_sources",
        risk_level(F.col("direct"), F.col("indirect"), F.col("max_depth")).alias("risk_level"))


def blast_radius_sketched(edges_df: DataFrame, depth: int = 10, lg_k: int = graph.LG_K) -> DataFrame:
    """:func:`blast_radius` for every table without listing pairs: sets of reached tables are sketches.

    The work is depth times (tables + edges). ``direct`` is exact; ``indirect``, ``total`` and ``data_sources`` are exact for small
    sets and off by about 1.04 / sqrt(2 ** lg_k) for large ones (1.6 % by default). ``max_depth`` is the last hop that made
    the estimate grow, so it can stay below the true depth where a hop adds few tables to very many.
    """
    numbered = graph.number(active_edges(edges_df))
    both = graph.sketch_spread(numbered.edges, numbered.nodes, depth, lg_k)
    below, above = both.where("way = 'down'"), both.where("way = 'up'").select(F.col("node").alias("root"), F.col("reached").alias("data_sources"))
    direct = numbered.edges.where("src <> dst").groupBy(F.col("src").alias("root")).agg(F.count("*").alias("direct"))
    down = below.select(F.col("node").alias("root"), "reached", F.col("last_hop").alias("max_depth")).join(direct, "root", "left")
    n = F.coalesce("direct", F.lit(0))
    return _verdicts(numbered, down.select("root", n.alias("direct"), F.greatest(F.col("reached") - n, F.lit(0)).alias("indirect"), "max_depth").join(above, "root"))


def change_impact(edges_df: DataFrame, requests: DataFrame, depth: int = 5) -> DataFrame:
    """Estimated effect of changes (root, change_type); counts downstream edges within ``depth`` hops."""
    edges = cut_lineage(active_edges(edges_df))
    numbered = graph.number(edges)
    reached = graph.spread(numbered.edges, _ids(numbered, requests), depth)
    totals = reached.join(_fan(numbered, edges, "src").withColumnRenamed("id", "node"), "node").groupBy("root").agg(F.sum("k").alias("affected_tables")).join(
        numbered.nodes.select(F.col("id").alias("root"), "node"), "root").select(F.col("node").alias("root"), "affected_tables")
    kinds = edges_df.sparkSession.createDataFrame(fixed.CHANGE_KINDS, "change_type string, severity string, description string, advice string")
    severity, description, advice = fixed.UNKNOWN_CHANGE
    counted = requests.join(totals, "root", "left").withColumn("affected_tables", F.coalesce("affected_tables", F.lit(0)))
    n = F.col("affected_tables")
    return counted.join(kinds, "change_type", "left").select(
        "root", "change_type",
        F.coalesce("severity", F.lit(severity)).alias("severity"),
        F.coalesce("description", F.lit(description)).alias("description"),
        n.alias("affected_tables"),
        (n * 3).alias("affected_queries"),
        F.floor(n / 2).cast("long").alias("affected_dashboards"),
        F.replace(F.coalesce("advice", F.lit(advice)), F.lit("%d"), n.cast("string")).alias("recommendation"))


class _Paths:
    """A search that carries paths: stored edges, and one stored table (root, node, path) for every hop."""

    def __init__(self, edges: DataFrame, starts: Callable[[DataFrame], DataFrame]):
        self._rounds = graph.Rounds(edges.sparkSession, "paths")
        self.edges = graph.Rounds(edges.sparkSession, "path-edges").add(edges.select("src", "dst").distinct())[0]
        self.newest, self._seen = self._rounds.add(starts(self.edges))

    @property
    def found(self) -> int:
        """New pairs of the newest hop."""
        return self._seen["n"]

    @property
    def hops(self) -> int:
        return len(self._rounds.paths)

    def known(self) -> DataFrame:
        return self._rounds.all(self.newest.schema)

    def extend(self, frontier: DataFrame) -> None:
        """Lengthens the paths of ``frontier`` by one edge and stores those to new (root, node) pairs, of equally long ones the smallest."""
        step = frontier.join(self.edges, F.col("node") == F.col("src")).groupBy("root", F.col("dst").alias("node")).agg(
            F.min(F.concat("path", F.array("dst"))).alias("path"))
        self.newest, self._seen = self._rounds.add(step.join(self.known().select("root", "node"), ["root", "node"], "left_anti"))


class _Meetings:
    """A search from both ends of wanted pairs: from sources along the edges, from targets against them, until the two sides meet.

    An end is (down, root): the search along the edges from a source, or against them from a target, shared by all pairs of that
    end. A round extends ends by one edge and is stored as (down, root, node, path, fan, age), ``fan`` being the number of edges that lead on.
    Pairs are stored with it: (root, goal, down_pairs, up_pairs, down_walk, up_walk, path), ``path`` once they have met. A pair is left when
    one of its sides has no edge to go on, so one that is not connected costs what the cheaper of both sides costs, not all that its source reaches.
    """

    FRESH, WAITING, LEFT = 0, 1, 2

    def __init__(self, edges: DataFrame, wanted: DataFrame):
        spark = edges.sparkSession
        one_way, _ = graph.Rounds(spark, "meeting-edges").add(edges.where("src <> dst").select("src", "dst").distinct())
        both = one_way.select(F.lit(True).alias("down"), F.col("src").alias("node"), F.col("dst").alias("to")).unionByName(
            one_way.select(F.lit(False).alias("down"), F.col("dst").alias("node"), F.col("src").alias("to")))
        fans = both.groupBy("node", "down").agg(F.count(F.lit(1)).alias("fan"))
        steps, _ = graph.Rounds(spark, "meeting-steps").add(both.join(fans.withColumnRenamed("node", "to"), ["to", "down"], "left").select(
            "down", "node", "to", F.coalesce("fan", F.lit(0)).alias("next_fan")))
        # every round joins them: they are dealt out by node and sorted once, on the disks of the executors, and made again from the stored table where these are lost
        self.edges = steps.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "node", "down").sortWithinPartitions("node", "down").persist(StorageLevel.DISK_ONLY)
        self._rounds, self._pairs, self._known = graph.Rounds(spark, "meetings"), graph.Rounds(spark, "meeting-pairs"), graph.Rounds(spark, "meeting-known")
        # a pair without an edge from its source or to its target is not connected
        ends = {}
        for way, root, down in (("down", "root", True), ("up", "goal", False)):
            shared = wanted.groupBy(F.col(root).alias("node")).agg(F.count(F.lit(1)).alias(f"{way}_pairs"))
            ends[root] = shared.join(fans.where(F.col("down") == down), "node", "left").select(F.col("node").alias(root), f"{way}_pairs", F.coalesce("fan", F.lit(0)).alias(f"{way}_walk"))
        self._keep(wanted.join(ends["root"], "root").join(ends["goal"], "goal").withColumn("path", F.when(F.col("root") == F.col("goal"), F.array("root"))).where(
            "path IS NOT NULL OR down_walk > 0 AND up_walk > 0"))
        starts = self.live.select(F.lit(True).alias("down"), "root", F.col("down_walk").alias("fan")).unionByName(
            self.live.select(F.lit(False).alias("down"), F.col("goal").alias("root"), F.col("up_walk").alias("fan"))).distinct()
        self.newest, _ = self._rounds.add(starts.select("down", "root", F.col("root").alias("node"), F.array("root").alias("path"), "fan", F.lit(self.FRESH).alias("age")))
        self._base, self._since, self._asked = None, 0, self.asked

    def _keep(self, pairs: DataFrame) -> None:
        """Stores pairs; those without a path are searched on."""
        stored, seen = self._pairs.add(pairs.select("root", "goal", "down_pairs", "up_pairs", "down_walk", "up_walk", "path"), F.count_if(F.col("path").isNull()).alias("asked"))
        self.live, self.asked = stored.where("path IS NULL").drop("path"), seen.get("asked") or 0
        self._schema = stored.schema

    def met(self) -> DataFrame:
        self.edges.unpersist()
        return self._pairs.all(self._schema).where("path IS NOT NULL")

    def _ends(self) -> DataFrame:
        """(down, root, go) of the live ends. A pair wants a side to go on that has walked at most twice what the other has, each divided by the pairs
        that share it: so one side at least goes on, and of a source with many targets hardly anything but the source."""
        down, up = F.col("down_walk") / F.col("down_pairs"), F.col("up_walk") / F.col("up_pairs")
        return self.live.select(F.lit(True).alias("down"), "root", (down <= 2 * up).alias("go")).unionByName(
            self.live.select(F.lit(False).alias("down"), F.col("goal").alias("root"), (up <= 2 * down).alias("go"))).groupBy("root", "down").agg(F.max("go").alias("go"))

    def _seen(self) -> DataFrame:
        """(down, root, node) of all rounds; kept for live ends only once half of the pairs are settled, so that late rounds don't read the early ones."""
        key = ["down", "root", "node"]
        late = self.newest.sparkSession.read.schema(self.newest.schema).parquet(*self._rounds.paths[self._since:]).where(F.col("age") == self.FRESH).select(*key)
        seen = late if self._base is None else self._base.unionByName(late)
        if self.asked <= self._asked / 2:
            seen, _ = self._known.add(seen.join(self._ends(), ["root", "down"], "left_semi").select(*key))
            self._base, self._since, self._asked = seen, len(self._rounds.paths), self.asked
        return seen

    def extend(self) -> None:
        """One round: the ends that are to go on do so by one edge, of equally long paths to a node the smallest stays; then the pairs are looked through."""
        columns = ["down", "root", "node", "path", "fan", "age"]
        frontier = self.newest.where(F.col("age") != self.LEFT).join(self._ends(), ["root", "down"])
        longer = F.when(F.col("down"), F.concat("path", F.array("to"))).otherwise(F.concat(F.array("to"), "path"))
        step = frontier.where("go").join(self.edges, ["node", "down"]).groupBy("root", F.col("to").alias("node"), "down").agg(F.min(longer).alias("path"), F.min("next_fan").alias("fan"))
        fresh = step.join(self._seen(), ["root", "node", "down"], "left_anti").withColumn("age", F.lit(self.FRESH))
        # what a target's side leaves behind is met by a source's side that goes on in the same round
        rest = frontier.where("NOT (go AND down)").withColumn("age", F.when(F.col("go"), self.LEFT).otherwise(self.WAITING))
        self.newest, _ = self._rounds.add(fresh.select(*columns).unionByName(rest.select(*columns)))
        self._look()

    def _look(self) -> None:
        """Pairs whose sides have met get their shortest path, of equally long ones the smallest; of the others those stay whose sides both go on."""
        fore = self.newest.where((F.col("age") != self.LEFT) & F.col("down")).select("root", "node", F.col("path").alias("head"))
        back = self.newest.where(~F.col("down")).select(F.col("root").alias("goal"), "node", F.col("path").alias("tail"))
        # the side with fewer nodes is listed for each pair and looked up in the other
        few = F.col("down_walk") <= F.col("up_walk")
        asked = self.live.select("root", "goal", few.alias("few"))
        both = asked.where("few").join(fore, "root").join(back, ["goal", "node"]).select("root", "goal", "head", "tail").unionByName(
            asked.where("NOT few").join(back, "goal").join(fore, ["root", "node"]).select("root", "goal", "head", "tail"))
        path = F.concat("head", F.slice("tail", F.lit(2), F.size("tail")))
        found = both.groupBy("root", "goal").agg(F.min(F.struct(F.size(path).alias("n"), path.alias("path"))).path.alias("path"))
        sides = self.newest.groupBy("root", "down").agg(
            F.sum(F.when(F.col("age") == self.FRESH, F.col("fan")).otherwise(0)).alias("walk"), F.max(F.col("age") == self.WAITING).alias("waits")).where("waits OR walk > 0")
        down = sides.where("down").select("root", F.col("walk").alias("down_more"))
        up = sides.where("NOT down").select(F.col("root").alias("goal"), F.col("walk").alias("up_more"))
        looked = self.live.join(down, "root", "left").join(up, "goal", "left").join(found, ["root", "goal"], "left").where(
            "path IS NOT NULL OR down_more IS NOT NULL AND up_more IS NOT NULL")
        self._keep(looked.withColumn("down_walk", F.col("down_walk") + F.col("down_more")).withColumn("up_walk", F.col("up_walk") + F.col("up_more")))


def shortest_paths(edges_df: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source, target, path) for every wanted pair that is connected, ties to the smallest path.

    One search serves all pairs, from their sources and from their targets at once; it ends for a pair when both sides meet, or when one
    of them has been wherever it leads.
    """
    wanted = pairs.select(F.col("source").alias("root"), F.col("target").alias("goal")).where("root IS NOT NULL AND goal IS NOT NULL").distinct()
    search = _Meetings(active_edges(edges_df), cut_lineage(wanted))
    while search.asked:
        search.extend()
    return search.met().select(F.col("root").alias("source"), F.col("goal").alias("target"), "path")


def shortest_path(edges_df: DataFrame, a: str, b: str) -> DataFrame:
    pairs = edges_df.sparkSession.createDataFrame([(a, b)], "source string, target string")
    return shortest_paths(edges_df, pairs).select("path")


def components(edges_df: DataFrame) -> DataFrame:
    """(component, node, size) of the tables that feed each other in a circle; ``component`` is the smallest name among them."""
    numbered = graph.number(active_edges(edges_df).select("src", "dst"))
    found = graph.strong_components(numbered.edges)
    named = found.join(numbered.nodes.select(F.col("id"), F.col("node").alias("name")), F.col("node") == F.col("id")).select("component", "name", "size")
    first = named.groupBy("component").agg(F.min("name").alias("first"))
    return named.join(first, "component").select(F.col("first").alias("component"), F.col("name").alias("node"), "size")


def cycles(edges_df: DataFrame, max_length: int | None = None) -> DataFrame:
    """Distinct shortest cycles through the nodes that reach themselves.

    A cycle is listed once, rotated to begin at its smallest node; ties go to the smallest path. Only edges within a class of
    colours are searched: a strongly connected component lies in one class whole, so no cycle is lost and few paths lead nowhere.
    """
    numbered = graph.number(active_edges(edges_df).select("src", "dst"))
    core = graph.trim(numbered.edges)
    name = lambda column: numbered.nodes.select(F.col("id").alias(column), F.col("node").alias(f"{column}_name"))
    inside = graph.within(core, graph.classes(core)[0], "class").join(name("src"), "src").join(name("dst"), "dst").select(
        F.col("src_name").alias("src"), F.col("dst_name").alias("dst"))
    search = _Paths(inside, lambda edges: edges.select(F.col("src").alias("root"), F.col("dst").alias("node"), F.array("src", "dst").alias("path")))
    while search.found and (max_length is None or search.hops < max_length):
        closed = search.known().filter("root = node").select("root")
        search.extend(search.newest.join(closed, "root", "left_anti"))
    ring = F.slice("path", F.lit(1), F.size("path") - 1)
    loops = search.known().filter("root = node").select(ring.alias("ring"))
    at = F.array_position("ring", F.array_min("ring")).cast("int")
    turned = F.concat(F.slice("ring", at, F.size("ring")), F.slice("ring", F.lit(1), at - 1))
    return loops.select(turned.alias("cycle")).distinct().withColumn("length", F.size("cycle"))


def affected_metrics(dependencies_df: DataFrame, tables: DataFrame) -> DataFrame:
    """(table_name, metric) pairs: metrics that depend on a table, directly or through others.

    ``dependencies_df``: parent_id depends on child_id. ``tables``: table_name.
    """
    numbered = graph.number(dependencies_df.select(F.col("child_id").alias("src"), F.col("parent_id").alias("dst")))
    pairs = graph.closure(numbered, _ids(numbered, tables.select(F.col("table_name").alias("root"))))
    name = lambda column, to: numbered.nodes.select(F.col("id").alias(column), F.col("node").alias(to))
    return pairs.join(name("root", "table_name"), "root").join(name("node", "metric"), "node").select("table_name", "metric")


def metric_impact(pairs: DataFrame, tables: DataFrame) -> DataFrame:
    """Affected metrics per table; criticality is high beyond five."""
    counted = pairs.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_metrics"))
    n = F.coalesce("n_metrics", F.lit(0))
    return tables.select("table_name").distinct().join(counted, "table_name", "left").select(
        "table_name", n.alias("n_metrics"), F.when(n > 5, "high").otherwise("medium").alias("criticality"))
