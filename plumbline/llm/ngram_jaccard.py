"""Operator 6: similarity join of word n-gram sets (three words unless ``size`` says otherwise) by Jaccard, over a token-group matrix.

Equal sets become one class at once. A fifth of the token space, the same for all, shows for each class how many of its tokens no other
class has; a class that has too many of them can't link with anything and leaves. The rest compare whole sets:

* A linked pair shares ``HITS`` tokens among the first ones of both sets (a tenth of the set and some at 90 percent), their prefixes, under
  any one order of all tokens. The order puts rare tokens first: those that few first cuts hold, then those that more than ``COMMON`` of them hold,
  then those that a bounded sample holds often, by their count there. Cuts are made where the text is read; a set whose cut shows too few rare tokens is read once
  more, whole. So no list of a rare token is long, and the order decides the cost only, never the result.
* Partition: each prefix token names the set that has it earliest; each set joins the most often named one it meets, its group's centre.
* Within a group a set is its difference D from the centre c. Two sets differ in ``|Da| + |Db| - 2 |Da & Db|`` tokens, so with
  ``phi = (100 + p) |D| - (100 - p) n`` they link if and only if ``2 (100 + p) |Da & Db| >= phi_a + phi_b``. Pairs with ``phi_a + phi_b <= 0`` both link to the
  centre and need no comparison. All others share tokens of D, whose lists are short: they meet on the rarest of those,
  and only if the tokens that no other member shares leave room for enough common ones.
* Between groups: the matrix holds, for each token and group, the union of the members' prefixes. A set opens a group if ``HITS`` of its
  prefix tokens lie in that union and the sizes fit, and is compared with the members that have as many of these tokens themselves.

Every comparison is exact, so no link between different texts is lost; tokens are 64-bit hashes, in the first filter 32-bit ones, where a
collision can only let more through. Components are found by label passes over stored tables.

Defined results: null, empty and blank texts have no set and are linked with nothing. Texts of fewer words than a shingle have one
shingle, the whole sequence. Rows with a null id are left out; repeated ids keep the row with the largest set (ties: its hash).
An empty table gives an empty result. Columns other than id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.block_names import look_up
from plumbline.llm.common import small_batches
from plumbline.session import remove, work_path

SIZE = 3
PERCENT = 90
SAMPLE = 5
KNOWN_WORDS = 100_000
#: Prefix tokens that a linked pair has in common at least; prefixes are longer by as many less one.
HITS = 2
#: Sets whose tokens are counted to order tokens, and the least count that matters; their quotient times the mean set size bounds the table.
SAMPLE_SETS, LEAST_COUNT = 10_000, 4
#: First cuts are longer than prefixes by this factor; a token that more of them hold than ``COMMON`` is no rare one.
LONGER, COMMON = 1.5, 8
#: Members of a group that meet one copy of its centre.
MEMBERS = 2_000
#: Ids up to this number are broadcast to pick their documents' texts; more of them take a shuffled join.
MAX_BROADCAST_IDS = 1_000_000
#: Texts that go to Python at a time.
BATCH_ROWS = 256
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[1]
    return x ^ (x >> np.uint64(29))


def shingle_hashes(text: str | None, known: dict[bytes, int], size: int = SIZE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text, A-Z lowered. ``known`` remembers word hashes."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    try:
        ones = [known[w] for w in words]
    except KeyError:
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        ones = [known[w] for w in words]
    one = np.array(ones, dtype=np.uint64)
    n = max(1, len(one) - size + 1)
    total = np.full(n, min(len(one), size), dtype=np.uint64)
    for i in range(min(size, len(one))):
        total = _finish(total * _MIX[0] + one[i : i + n] * _MIX[2])
    return np.unique(total)


def _sets(docs: DataFrame, doc_id: str, text: str, whole: bool, size: int, cut: tuple | None = None) -> DataFrame:
    """``doc_id, n, sig1, sig2`` and the token sample as 32-bit numbers, or with ``whole`` all tokens as 64-bit numbers (with ``cut`` the prefix)."""
    schema = "doc_id long, n long, sig1 long, sig2 long, tokens array<" + ("long>" if whole else "int>") + (", unknown int" if cut else "")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                sets = [shingle_hashes(t, known, size) for t in part.column(1).to_pylist()]
                sums = np.array([(s.sum(dtype=np.uint64), np.bitwise_xor.reduce(_finish(s + _MIX[0])) if len(s) else 0) for s in sets], dtype=np.uint64).view(np.int64)
                cuts = [_cut(s, *cut) for s in sets] if cut else []
                held = [c.view(np.int64) for c, _ in cuts] if cut else [s.view(np.int64) for s in sets] if whole else [
                    np.unique(s[s % np.uint64(SAMPLE) == 0].astype(np.uint32).view(np.int32)) for s in sets]
                ends = pa.array(np.cumsum([0, *map(len, held)]), pa.int32())
                tokens = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(held), pa.int64() if whole else pa.int32()))
                columns = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 1]), tokens]
                if cut:
                    columns.append(pa.array([u for _, u in cuts], pa.int32()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "sig1", "sig2", "tokens", "unknown"][: len(columns)])

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    return given.mapInArrow(made, schema)


class _Store:
    """Tables in the shared folder that steps write once and read again, until no later step needs them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n, self.held = spark, work_path(spark, "jaccard"), 0, {}

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.held[path] = table
        return table

    def free(self, *tables: DataFrame) -> None:
        """Deletes these tables; all that was made from them has to be stored."""
        self._delete([path for path, held in self.held.items() if any(held is t for t in tables)])

    def free_but(self, *tables: DataFrame) -> None:
        """Deletes all tables but these."""
        self._delete([path for path, held in self.held.items() if not any(held is t for t in tables)])

    def _delete(self, paths: list[str]) -> None:
        remove(self.spark, paths)
        for path in paths:
            del self.held[path]


def connect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, size: int = SIZE) -> DataFrame:
    """One row for each document: ``doc_id, n_shingles, component_id`` (the smallest id reachable by links)."""
    with small_batches(docs.sparkSession, BATCH_ROWS):  # all texts are read inside; the result reads stored tables
        return _connect(docs, doc_id, text, percent, size)


def _connect(docs: DataFrame, doc_id: str, text: str, percent: int, size: int) -> DataFrame:
    store = _Store(docs.sparkSession)
    sets = store.keep(_sets(docs, doc_id, text, whole=False, size=size))
    # one row an id; equal ids are rare, so only the narrow columns move
    narrow = store.keep(sets.groupBy("doc_id").agg(F.max(F.struct("n", "sig1", "sig2")).alias("s")).select("doc_id", "s.*"))
    sampled = sets.where("n > 0").groupBy("sig1", "sig2", "n").agg(F.min("doc_id").alias("rep"), F.first("tokens").alias("tokens"))
    sampled = store.keep(sampled.select("rep", "sig1", "sig2", "n", "tokens"))
    classes = store.keep(sampled.drop("tokens"))
    store.free(sets)
    links = store.keep(_links(docs, doc_id, text, classes, sampled, store, percent, size))
    store.free_but(narrow, classes, links)
    component = _components(links, store)
    grouped = narrow.join(classes.select("sig1", "sig2", F.col("n").alias("n"), "rep"), ["sig1", "sig2", "n"], "left")
    named = grouped.join(component.withColumnRenamed("id", "rep"), "rep", "left")
    # a component is named after its smallest representative, itself the smallest id of its class
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def _links(docs: DataFrame, doc_id: str, text: str, classes: DataFrame, sampled: DataFrame, store: _Store, percent: int, size: int) -> DataFrame:
    """Linked pairs ``a, b`` of class representatives, enough of them to connect all that any link connects. ``sampled`` holds the classes with
    their token samples; it is freed."""
    slack = F.floor(F.col("n") * (100 - percent) / 100)  # tokens of a set that a linked set may lack
    tokens = sampled.select("rep", F.explode("tokens").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    common = tokens.join(shared, "token").groupBy("rep").agg(F.count("*").alias("common"))
    sized = sampled.select("rep", "n", F.size("tokens").alias("s"))
    able = store.keep(sized.join(common, "rep", "left").where(F.col("s") - F.coalesce("common", F.lit(0)) <= slack).select("rep"))
    store.free(sampled)
    n_able = able.count()
    own = classes.select(F.col("rep").alias("doc_id"), "sig1", "sig2")
    repeats = _repeats(docs, doc_id)

    def few(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if n_able <= MAX_BROADCAST_IDS else ids

    def read(ids: DataFrame, cut: tuple | None = None) -> DataFrame:
        """``rep, n, tokens`` of some representatives, from their texts; with ``cut`` the prefixes only."""
        picked = docs.where(F.col(doc_id).isNotNull()).join(few(ids), docs[doc_id].cast("long") == ids["rep"], "left_semi")
        sets = _sets(picked, doc_id, text, whole=True, size=size, cut=cut)
        if repeats:  # of rows with one id, the one that the class stands for
            sets = sets.dropDuplicates(["doc_id", "sig1", "sig2"]).join(own, ["doc_id", "sig1", "sig2"], "left_semi")
        return sets.select(F.col("doc_id").alias("rep"), "n", "tokens", *(["unknown"] if cut else []))

    known = _counted(read(able.where(F.pmod(F.xxhash64("rep"), F.lit(max(1, n_able // SAMPLE_SETS))) == 0)))
    cuts = store.keep(read(able, (percent, LONGER, *known)))
    rare = cuts.select(F.explode(F.slice("tokens", F.lit(1), F.col("unknown"))).alias("token"))
    common = store.keep(rare.groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") > COMMON).select("token"))
    first = store.keep(_reordered(cuts, common, percent))
    short = store.keep(first.where("short").select("rep"))
    again = store.keep(_reordered(read(short, (percent, None, *known)), common, percent))
    at = first.where("NOT short").unionByName(again).select("rep", "n", F.posexplode("tokens").alias("pos", "token"))
    lists = at.groupBy("token").agg(F.count("*").alias("c"), F.min(F.struct("pos", "rep")).alias("first")).where("c > 1")
    lists = store.keep(lists.select("token", "c", F.col("first.rep").alias("named")))
    prefix = store.keep(look_up(at, lists, ["token"], "c"))
    store.free(able, cuts, common, first, short, again, lists)
    centre = _centres(prefix, store)
    placed = store.keep(_differences(centre, read, few, store, percent))
    to_centre = placed.where("linked AND rep <> grp").select(F.col("rep").alias("a"), F.col("grp").alias("b"))
    inside = store.keep(_within(placed, store, percent))
    met = store.keep(_between(prefix, placed, store, percent))
    compared = store.keep(read(store.keep(met.select(F.col("a").alias("rep")).unionAll(met.select(F.col("b").alias("rep"))).distinct())))
    between = store.keep(_compare(met, compared).where(_similar(percent)).select("a", "b"))
    return to_centre.unionAll(inside).unionAll(between)


def _counted(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that several sampled sets hold, in ascending order, and how many do."""
    seen = sample.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").cast("int").alias("c")).where(F.col("c") >= LEAST_COUNT).toArrow()
    tokens = np.array(seen.column("token"), dtype=np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.array(seen.column("c"), dtype=np.int32)[order]


def _cut(tokens: np.ndarray, percent: int, longer: float | None, known: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The first tokens of a sorted set, the whole set without ``longer``, and how many of them the sample doesn't know; these come first,
    in the order of their hashes, and the known ones by count."""
    keep = len(tokens) if longer is None else int(longer * (len(tokens) * (100 - percent) // 100 + HITS))
    if not len(known):
        return tokens[:keep], len(tokens[:keep])
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    often = np.where(known[at] == tokens, counts[at], 0)
    order = np.argsort(often, kind="stable")[:keep]
    return tokens[order], int(np.count_nonzero(often[order] == 0))


def _reordered(cuts: DataFrame, common: DataFrame, percent: int) -> DataFrame:
    """``rep, n, tokens, short``: prefixes with the common tokens behind the rare ones; ``short`` if rare ones beyond the cut are needed."""
    rare = F.slice("tokens", F.lit(1), F.col("unknown"))
    low = cuts.select("rep", F.explode(rare).alias("token")).join(common, "token").groupBy("rep").agg(F.collect_set("token").alias("low"))
    marked = cuts.join(low, "rep", "left").withColumn("low", F.coalesce("low", F.array().cast("array<bigint>")))
    good, need = F.array_except(rare, "low"), (F.floor(F.col("n") * (100 - percent) / 100) + HITS).cast("int")
    ordered = F.concat(good, F.array_intersect(rare, "low"), F.slice("tokens", F.col("unknown") + 1, F.size("tokens")))
    cut_off = (F.col("unknown") == F.size("tokens")) & (F.size("tokens") < F.col("n"))
    return marked.select("rep", "n", F.slice(ordered, F.lit(1), need).alias("tokens"), (cut_off & (F.size(good) < need)).alias("short"))


def _centres(prefix: DataFrame, store: _Store) -> DataFrame:
    """``rep, n, grp``: the centre of each set that shares a prefix token. Any choice is right; few and large groups are cheap."""
    named = store.keep(prefix.select("rep", "named").distinct())
    votes = store.keep(named.groupBy("named").agg(F.count("*").alias("votes")))
    best = look_up(named, votes, ["named"], "votes").groupBy("rep").agg(F.max(F.struct("votes", (-F.col("named")).alias("id"))).alias("best"))
    to = store.keep(best.select("rep", (-F.col("best.id")).alias("grp")))
    # the most named set of all that lead to one another; votes never fall along the way, and a centre is its own
    for _ in range(3):
        known = to.groupBy("grp").agg(F.count("*").alias("members")).join(to.select(F.col("rep").alias("grp"), F.col("grp").alias("next")), "grp")
        to = store.keep(look_up(to, store.keep(known), ["grp"], "members").select("rep", F.col("next").alias("grp")))
    centres = to.select(F.col("grp").alias("rep")).distinct().withColumn("is_centre", F.lit(True))
    sizes = prefix.groupBy("rep").agg(F.first("n").alias("n"))
    return store.keep(to.join(centres, "rep", "left").join(sizes, "rep").select("rep", "n", F.when(F.col("is_centre"), F.col("rep")).otherwise(F.col("grp")).alias("grp")))


def _differences(centre: DataFrame, read: Callable[[DataFrame], DataFrame], few: Callable[[DataFrame], DataFrame], store: _Store, percent: int) -> DataFrame:
    """``rep, n, grp, nc, d, phi, linked``: each set as its difference from the centre; sets that have little of theirs are their own.

    Whole sets go from their texts right to their centre: they are neither stored nor moved twice.
    """
    copies = store.keep(centre.where("rep <> grp").groupBy(F.col("grp").alias("id")).agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("copies")))
    away = look_up(centre.where("rep <> grp").withColumnRenamed("grp", "id"), copies.withColumn("c", F.col("copies").cast("long")), ["id"], "c").drop("c")
    away = store.keep(away.select("rep", "id", F.pmod(F.xxhash64("rep"), F.col("copies")).cast("int").alias("copy")))
    middle = read(copies.select(F.col("id").alias("rep"))).join(few(copies.withColumnRenamed("id", "rep")), "rep")
    centres = middle.select(F.col("rep").alias("id"), F.col("n").alias("nc"), F.col("tokens").alias("tc"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    both = read(away.select("rep")).withColumnRenamed("tokens", "ta").join(few(away), "rep").join(centres, ["id", "copy"])
    apart = both.select("rep", "n", F.col("id").alias("grp"), "nc", F.concat(F.array_except("ta", "tc"), F.array_except("tc", "ta")).alias("d"))
    close = 2 * F.size("d") <= F.col("n") + F.col("nc")
    none = F.array().cast("array<bigint>")
    apart = apart.select("rep", "n", F.when(close, F.col("grp")).otherwise(F.col("rep")).alias("grp"), F.when(close, F.col("nc")).otherwise(F.col("n")).alias("nc"), F.when(close, F.col("d")).otherwise(none).alias("d"))
    alone = centre.where("rep = grp").select("rep", "n", "grp", F.col("n").alias("nc"), none.alias("d"))
    phi = (100 + percent) * F.size("d") - (100 - percent) * F.col("n")
    return apart.unionByName(alone).withColumn("phi", phi).withColumn("linked", F.col("phi") <= (100 - percent) * F.col("nc"))


def _within(placed: DataFrame, store: _Store, percent: int) -> DataFrame:
    """Linked pairs of one group that are not both linked to its centre."""
    twice = 2 * (100 + percent)
    spread = placed.select("rep", "grp", F.explode("d").alias("token"))
    seen = store.keep(spread.groupBy("grp", "token").agg(F.count("*").alias("c")).where("c > 1"))
    held = look_up(spread, seen, ["grp", "token"], "c").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("held"))
    # a set has at least so many tokens of D in common with any set that it links to, the centre and those linked with it included
    least = F.greatest(F.ceil((F.col("phi") - (100 - percent) * F.col("nc")) / 200), F.lit(1))
    keep = (F.size("held") - least + 1).cast("int")
    sized = placed.select("rep", "grp", "n", "nc", "phi", "linked").join(held, "rep").withColumn("keep", keep).where("keep > 0")
    members = store.keep(sized.select("rep", "grp", "phi", "linked", (twice * F.size("held") - F.col("phi")).alias("spare"), F.slice("held", F.lit(1), F.col("keep"))["token"].alias("held")))
    bounds = members.groupBy("grp").agg(F.count("*").alias("members"), F.max("spare").alias("most"), F.min(F.when(~F.col("linked"), F.col("phi"))).alias("least")).where("least IS NOT NULL")
    near = look_up(members, store.keep(bounds), ["grp"], "members").where("(linked AND spare >= least) OR (NOT linked AND phi <= most)")
    near = store.keep(near.select("rep", "grp", "phi", "spare", "linked", F.explode("held").alias("token")))
    q, m = near.where("NOT linked").alias("q"), near.alias("m")
    met = q.join(m, ["grp", "token"]).where((F.col("m.linked") | (F.col("q.rep") < F.col("m.rep"))) & (F.col("q.phi") <= F.col("m.spare")) & (F.col("m.phi") <= F.col("q.spare")))
    pairs = met.select(F.col("q.rep").alias("a"), F.col("m.rep").alias("b"), (F.col("q.phi") + F.col("m.phi")).alias("phi")).distinct()
    d = placed.select("rep", "d")
    checked = pairs.join(d.select(F.col("rep").alias("a"), F.col("d").alias("da")), "a").join(d.select(F.col("rep").alias("b"), F.col("d").alias("db")), "b")
    return checked.where(twice * F.size(F.array_intersect("da", "db")) >= F.col("phi")).select("a", "b")


def _between(prefix: DataFrame, placed: DataFrame, store: _Store, percent: int) -> DataFrame:
    """Pairs of different groups that can link, over the token-group matrix."""
    rows = store.keep(prefix.select("token", "rep").join(placed.select("rep", "n", "grp"), "rep"))
    matrix = store.keep(rows.groupBy("token", "grp").agg(F.min("n").alias("least"), F.max("n").alias("most")))
    fits = (100 * F.col("m.most") >= percent * F.col("q.n")) & (100 * F.col("q.n") >= percent * F.col("m.least"))
    opened = rows.alias("q").join(matrix.alias("m"), (F.col("q.token") == F.col("m.token")) & (F.col("q.grp") < F.col("m.grp")) & fits).groupBy(
        F.col("q.rep").alias("a"), F.col("m.grp").alias("grp")).agg(F.first("q.n").alias("na"), F.collect_list("q.token").alias("tokens"))
    enough = _enough("na", "na", percent)
    opened = opened.where(F.size("tokens") >= enough).select("a", "na", "grp", F.explode("tokens").alias("token"))
    met = opened.join(rows.select("token", "grp", F.col("rep").alias("b"), F.col("n").alias("nb")), ["token", "grp"]).where(
        (100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na")))
    counted = met.groupBy("a", "b").agg(F.count("*").alias("hits"), F.first("na").alias("x"), F.first("nb").alias("y"))
    return counted.where(F.col("hits") >= _enough("x", "y", percent)).select("a", "b")


def _enough(n: str, m: str, percent: int):
    """Prefix tokens that linked sets of these sizes share at least: ``HITS``, or what the smaller one can hold."""
    return F.least(F.lit(HITS), F.ceil(F.least(n, m) * percent / 100))


def _repeats(docs: DataFrame, doc_id: str) -> bool:
    """True if an id occurs twice."""
    return not docs.where(F.col(doc_id).isNotNull()).groupBy(doc_id).count().where("count > 1").isEmpty()


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, na, nb, both`` with the exact size of the intersection."""
    left = pairs.join(sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta")), "a")
    joined = left.join(sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb")), "b")
    return joined.select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("both"))


def _similar(percent: int):
    return 100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))


def _components(links: DataFrame, store: _Store) -> DataFrame:
    """``id, component`` of all linked ids: the smallest label spreads over links and then jumps along labels until nothing changes."""
    edges = store.keep(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = store.keep(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("component")))
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = step.join(labels.select(F.col("id").alias("component"), F.col("component").alias("far")), "component", "left")
        fresh = store.keep(jump.select("id", "old", F.least("component", F.coalesce("far", "component")).alias("component")))
        labels = fresh.select("id", "component")
        if not fresh.where("old <> component").limit(1).collect():
            return labels


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents whose id names their component: one of each group stays. Rows with a null id stay."""
    named = connect(docs, doc_id, text, **options)
    gone = named.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs[doc_id].cast("long") == gone["__gone"], "left_anti")
