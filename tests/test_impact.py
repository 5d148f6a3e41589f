import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import impact as I
from plumbline.plans import graph as G
from tests.conftest import rows


def graph(spark, *edges):
    return spark.createDataFrame([(e[0], e[1], e[2] if len(e) > 2 else True) for e in edges], "source_table_id string, target_table_id string, is_active boolean")


@pytest.fixture(scope="module")
def diamond(spark):
    return graph(spark, ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("a", "z", False), ("s", "s"))


def test_reach_counts_hops_once(diamond):
    assert rows(I.downstream(diamond, "a"), "node", "hop") == [("b", 1), ("c", 1), ("d", 2), ("e", 3)]
    assert rows(I.downstream(diamond, "a", 1), "node", "hop") == [("b", 1), ("c", 1)]
    assert rows(I.upstream(diamond, "e"), "node", "hop") == [("a", 3), ("b", 2), ("c", 2), ("d", 1)]
    assert rows(I.downstream(diamond, "s"), "node", "hop") == []


def test_chain_respects_depth(spark):
    chain = graph(spark, *[(f"t{i:03d}", f"t{i + 1:03d}") for i in range(20)])
    assert I.downstream(chain, "t000", 5).count() == 5
    assert I.upstream(chain, "t020", 7).count() == 7


def test_blast_radius(diamond):
    got = {r.root: tuple(r)[1:] for r in I.blast_radius(diamond).collect()}
    assert got["a"] == (2, 2, 4, 3, 14, 0, "HIGH") or got["a"] == (2, 2, 4, 3, 14, 0, "MEDIUM")
    assert got["e"] == (0, 0, 0, 0, 0, 4, "LOW")
    assert got["s"] == (0, 0, 0, 0, 0, 0, "LOW")


def test_blast_radius_compat_counts_edges(diamond):
    got = {r.root: tuple(r)[1:] for r in I.blast_radius(diamond, compat=True).collect()}
    # two edges leave the hop-1 tables, one leaves hop 2
    assert got["a"][:3] == (2, 1, 3)
    assert got["e"][5] == 5


@pytest.mark.parametrize("direct, indirect, depth, level", [
    (0, 0, 9, "LOW"), (3, 2, 2, "LOW"), (3, 2, 3, "MEDIUM"), (5, 5, 3, "MEDIUM"), (5, 6, 3, "HIGH"), (10, 10, 5, "HIGH"), (10, 11, 5, "CRITICAL"), (1, 0, 6, "CRITICAL")])
def test_risk(spark, direct, indirect, depth, level):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(direct, indirect, depth)], "a int, b int, c int")
    assert df.select(I.risk_level(F.col("a"), F.col("b"), F.col("c"))).first()[0] == level


def test_paths(spark, diamond):
    assert I.shortest_path(diamond, "a", "e").first().path == ["a", "b", "d", "e"]
    assert I.shortest_path(diamond, "a", "a").first().path == ["a"]
    assert I.shortest_path(diamond, "e", "a").count() == 0


def _smallest_shortest(edges, source):
    """Breadth-first from one source: node -> shortest path, the smallest of equally long ones."""
    found = level = {source: [source]}
    while level:
        step = {}
        for a, b in edges:
            if a in level and b not in found:
                step[b] = min(step.get(b, level[a] + [b]), level[a] + [b])
        found, level = found | step, step
    return found


@pytest.mark.parametrize("seed, n, m", [(1, 14, 22), (2, 9, 30)])
def test_paths_from_both_ends_against_brute_force(spark, seed, n, m):
    rng = random.Random(seed)
    links = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)]
    off = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", False) for _ in range(4)]
    edges = graph(spark, *links, *links[:3], *off, ("n0", None), (None, "n1"))
    asked = [(f"n{a}", f"n{b}") for a in range(n) for b in range(n)] * 2 + [("q", "q"), ("q", "n1"), ("n1", "q"), (None, "n1"), ("n1", None), (None, None)]
    got = rows(I.shortest_paths(edges, spark.createDataFrame(asked, "source string, target string")))
    paths = {s: _smallest_shortest(links, s) for s, _ in asked if s}
    assert got == sorted([(s, t, paths[s][t]) for s, t in set(asked) if s and t in paths[s]], key=str)


def test_many_targets_of_one_source_and_the_other_way_round(spark):
    fan = graph(spark, *[("a", f"m{i % 3}") for i in range(3)], *[(f"m{i % 3}", f"t{i}") for i in range(30)], *[(f"t{i}", "z") for i in range(30)])
    one = spark.createDataFrame([("a", f"t{i}") for i in range(30)] + [("t0", "a")], "source string, target string")
    assert rows(I.shortest_paths(fan, one)) == sorted([("a", f"t{i}", ["a", f"m{i % 3}", f"t{i}"]) for i in range(30)], key=str)
    other = spark.createDataFrame([(f"m{i}", "z") for i in range(3)] + [("z", "a")], "source string, target string")
    assert rows(I.shortest_paths(fan, other)) == sorted([(f"m{i}", "z", [f"m{i}", min(f"t{k}" for k in range(i, 30, 3)), "z"]) for i in range(3)], key=str)


def test_a_target_that_little_leads_to_ends_its_search(spark, monkeypatch):
    stored, add = [], G.Rounds.add

    def counted(self, df, *counters):
        table, seen = add(self, df, *counters)
        stored.append(seen["n"])
        return table, seen

    monkeypatch.setattr(G.Rounds, "add", counted)
    n = 60
    edges = graph(spark, *[(f"c{i:02d}", f"c{i + 1:02d}") for i in range(n - 1)], *[(f"y{i}", f"x{i}") for i in range(n)])
    assert I.shortest_paths(edges, spark.createDataFrame([(f"c{i:02d}", f"x{i}") for i in range(n)], "source string, target string")).count() == 0
    # everything that the sources reach would be n * (n + 1) / 2 = 1830 rows
    assert sum(stored) < 1000


def test_cycles(spark, diamond):
    loops = graph(spark, ("b", "a"), ("a", "b"), ("x", "y"), ("y", "z"), ("z", "x"), ("z", "w"), ("w", "q"), ("s", "s"))
    assert sorted((r.cycle for r in I.cycles(loops).collect()), key=str) == [["a", "b"], ["s"], ["x", "y", "z"]]
    assert I.cycles(graph(spark, ("a", "b"), ("b", "c"))).count() == 0


def test_change_impact(spark, diamond):
    asked = spark.createDataFrame([("a", "column_deleted"), ("e", "row_deletion"), ("a", "other")], "root string, change_type string")
    got = {(r.root, r.change_type): r for r in I.change_impact(diamond, asked).collect()}
    top = got["a", "column_deleted"]
    assert (top.severity, top.affected_tables, top.affected_queries, top.affected_dashboards) == ("high", 5, 15, 2)
    assert top.recommendation == "Review 5 dependent tables before deletion. Consider deprecation period."
    assert got["e", "row_deletion"].affected_tables == 0
    assert (got["a", "other"].severity, got["a", "other"].recommendation) == ("unknown", "Review impact carefully.")


def test_metric_impact_is_transitive(spark):
    deps = spark.createDataFrame([("m1", "t"), ("m2", "m1"), ("m3", "m2"), ("m4", "u")] + [(f"n{i}", "u") for i in range(5)], "parent_id string, child_id string")
    tables = spark.createDataFrame([("t",), ("u",), ("v",)], "table_name string")
    pairs = I.affected_metrics(deps, tables)
    assert rows(pairs.filter("table_name = 't'"), "metric") == [("m1",), ("m2",), ("m3",)]
    assert rows(I.metric_impact(pairs, tables)) == [("t", 3, "medium"), ("u", 6, "high"), ("v", 0, "medium")]


def brute_reach(edges):
    """node -> {other: hops} by plain searches."""
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
        after.setdefault(b, set())
    out = {}
    for start in after:
        hops, front = {start: 0}, [start]
        while front:
            front = [x for n in front for x in after[n] if x not in hops and not hops.update({x: hops[n] + 1})]
        out[start] = hops
    return out


def random_edges(seed, n, m):
    rng = random.Random(seed)
    rings = [(f"r{k}_{i}", f"r{k}_{(i + 1) % k}") for k in range(1, 7) for i in range(k)]
    chain = [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(30)] + [("c29", "c05"), ("r3_1", "c00"), ("c30", "r6_0")]
    return sorted({(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)} | set(rings) | set(chain))


@pytest.mark.parametrize("seed, n, m", [(1, 40, 45), (2, 40, 80), (3, 60, 40)])
def test_components_and_cycles_against_brute_force(spark, seed, n, m):
    edges = random_edges(seed, n, m)
    reach = brute_reach(edges)
    df = graph(spark, *edges)
    want = {}
    for a in reach:
        own = sorted(b for b in reach[a] if a in reach[b])
        if len(own) > 1 or (a, a) in edges:
            want[a] = (own[0], len(own))
    got = {r.node: (r.component, r.size) for r in I.components(df).collect()}
    assert got == want
    found = {tuple(r.cycle) for r in I.cycles(df).collect()}
    on_cycles = {x for c in found for x in c}
    assert on_cycles == set(want)
    for c in found:
        assert all((a, b) in edges for a, b in zip(c, c[1:] + c[:1])) and c[0] == min(c) and len(set(c)) == len(c)
    shortest = {a: min(reach[b][a] + 1 for x, b in edges if x == a and a in reach[b]) for a in want}
    assert all(min(len(c) for c in found if a in c) == shortest[a] for a in want)


def test_closure_over_the_condensation(spark):
    edges = random_edges(4, 50, 70)
    reach = brute_reach(edges)
    numbered = G.number(spark.createDataFrame(edges, "src string, dst string"))
    names = {r.id: r.node for r in numbered.nodes.collect()}
    small = G.condense(numbered)
    assert I.cycles(graph(spark, *[(str(r.src), str(r.dst)) for r in small.edges.collect()])).count() == 0
    pairs = G.closure(numbered, numbered.nodes.select(F.col("id").alias("root")))
    assert {(names[r.root], names[r.node]) for r in pairs.collect()} == {(a, b) for a in reach for b in reach[a] if a != b}


def test_sketches_against_exact_counts(spark):
    """Small sets are exact; a set of thousands is within three standard errors; loops and rings end."""
    edges = random_edges(5, 60, 90)
    exact = {r.root: r for r in I.blast_radius(graph(spark, *edges)).collect()}
    got = {r.root: r for r in I.blast_radius_sketched(graph(spark, *edges)).collect()}
    assert {k: tuple(r) for k, r in got.items()} == {k: tuple(r) for k, r in exact.items()}
    wide = spark.range(20_000).select(F.lit("hub").alias("source_table_id"), F.concat(F.lit("x"), F.col("id")).alias("target_table_id"), F.lit(True).alias("is_active"))
    wide = wide.unionByName(wide.select(F.col("target_table_id").alias("source_table_id"), F.concat(F.lit("y"), F.col("target_table_id")).alias("target_table_id"), "is_active"))
    hub = I.blast_radius_sketched(wide).where("root = 'hub'").first()
    assert hub.direct == 20_000 and abs(hub.total - 40_000) < 3 * 0.0163 * 40_000 and hub.max_depth == 2
    coarse = I.blast_radius_sketched(wide, lg_k=6).where("root = 'hub'").first()
    assert abs(coarse.total - 40_000) < 4 * 0.13 * 40_000


def test_sketches_go_both_ways_in_one_search(spark, monkeypatch):
    """A chain with a fan at its end, two loops and a pair of rings: one stored table a hop serves both ways, each way with its own last hop."""
    stored = []
    add = G.Rounds.add
    monkeypatch.setattr(G.Rounds, "add", lambda self, df, *counters: stored.append(self.root.rsplit("/", 1)[-1]) or add(self, df, *counters))
    edges = [(f"c{i}", f"c{i + 1}") for i in range(5)] + [("c5", f"x{i}") for i in range(9)] + [("c0", "c0"), ("x3", "x3"), ("r", "s"), ("s", "r")]
    numbered = G.number(spark.createDataFrame(edges, "src string, dst string"))
    names = {r.id: r.node for r in numbered.nodes.collect()}
    got = {(r.way, names[r.node]): (r.reached, r.last_hop) for r in G.sketch_spread(numbered.edges, numbered.nodes, 10).collect()}
    want = {("down", f"c{i}"): (5 - i + 9, 6 - i) for i in range(6)} | {("up", f"c{i}"): (i, i) for i in range(6)}
    want |= {("down", f"x{i}"): (0, 0) for i in range(9)} | {("up", f"x{i}"): (6, 6) for i in range(9)} | {(w, x): (1, 1) for w in ("down", "up") for x in "rs"}
    assert got == want
    assert stored.count("sketches") == 8  # the start, six hops with news, one without


def test_no_edges(spark):
    none = graph(spark, ("a", "b", False))
    assert I.components(none).count() == I.cycles(none).count() == I.blast_radius(none).count() == I.blast_radius_sketched(none).count() == 0
    deps = spark.createDataFrame([], "parent_id string, child_id string")
    assert I.affected_metrics(deps, spark.createDataFrame([("t",)], "table_name string")).count() == 0


def test_trim_goes_on_to_the_circle(spark):
    """A tree of eight levels above a circle and one below it go layer by layer; edges on circles and between them stay."""
    above = [(f"u{i}", f"u{i // 2}") for i in range(2, 256)] + [("u1", "r0")]
    below = [(f"d{i // 2}", f"d{i}") for i in range(2, 256)] + [("r1", "d1")]
    kept = [("r0", "r1"), ("r1", "r0"), ("r1", "m"), ("m", "s"), ("s", "s")]
    edges = spark.createDataFrame(above + below + kept, "src string, dst string")
    assert rows(G.trim(edges)) == sorted(kept)
    assert G.trim(edges.limit(0)).count() == 0
    assert rows(I.components(graph(spark, *above, *below, *kept)), "component", "node", "size") == [("r0", "r0", 2), ("r0", "r1", 2), ("s", "s", 1)]
