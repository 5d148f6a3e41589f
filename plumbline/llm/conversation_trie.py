"""Prefix trie of conversations by whole-sequence collapse.

1. Conversations are rebuilt, each with a key for every prefix: sha256 over the turns so far, kept up while the sorted turns of a
   conversation stream through a task. From here on no row carries text.
2. Identical sequences collapse into one weighted sequence (count, smallest member) with a list of the conversations that end there, one row
   per end. Only the smallest member's rows go on, so a conversation that a third of all rows repeat counts once.
3. A sequence that is a proper prefix of another one is dropped by an anti-join against the inner prefixes; what stays are the leaves.
4. Weighted prefixes are aggregated: members, children, leaves. What a subtree saves is summed through sequences: each node belongs to the
   sequence of its smallest member, so a suffix sum along every sequence and one aggregation by prefix count each node once.

The groups of shared first turns are aggregated map-side. Where rows meet their node again, nodes with more than one row in ten thousand
are joined by broadcast (there are fewer than ten thousand of them), so no hot prefix is a shuffle key.

Turns sort by ``turn`` (null first), turns with equal numbers by the sha256 of role and text; repeated rows are turns of their own. Null
roles and texts count as empty. Rows without ``conv_id`` belong to no conversation and are left out. An empty table gives no nodes, not even
the root. Extra columns are not read. A text may be of any length; a conversation may be of any length too: it is sorted with spilling and
streamed, and only the running hash is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.block_names import look_up
from plumbline.llm.common import words_of
from plumbline.session import work_path

NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Ends are packed by ranges of this many ids before a node's list is hashed; ids in a list are distinct, so a pack holds no more.
PACK = 4096


def fingerprints(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, print, n_words) of every turn with a conversation; ``print`` is 32 bytes over role and text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    # the role's length comes first, so no other cut of the joined text gives the same bytes
    whole = F.concat(F.length(role.cast("binary")).cast("string"), F.lit(":"), role, text)
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.sha2(whole, 256)).alias("print"), F.size(words_of(text)).cast("long").alias("n_words"))


def number_turns(prints: DataFrame) -> DataFrame:
    """(conv_id, at, print, n_words): turns counted from 1 in their order."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "print")
    return prints.select("conv_id", F.row_number().over(order).alias("at"), "print", "n_words")


def rebuild(turns: DataFrame, block: int = 20, heads: int = 4) -> DataFrame:
    """(conv_id, at, print, n_words) of rebuilt conversations; ``at`` keeps their order. Each has a row at 0 without a print, its start.

    A conversation takes the first ``h`` turns of the first conversation in its block of ids and goes on with its own turns after the
    first ``h``, where ``h`` is crc32 of its id modulo ``heads``.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    ids = turns.where("at = 1").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % block).alias("first"))
    shared = turns.where((F.col("conv_id") % block == 0) & (F.col("at") < heads)).select(F.col("conv_id").alias("first"), "at", "print", "n_words")
    borrowed = ids.where("h > 0").join(shared, "first").where("at <= h").select("conv_id", "at", "print", "n_words")
    own = turns.where(F.col("at") > h)
    starts = ids.select("conv_id", F.lit(0).alias("at"), F.lit(None).cast("binary").alias("print"), F.lit(0).cast("long").alias("n_words"))
    return starts.unionByName(borrowed).unionByName(own)


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """(conv_id, depth, key, above, n_words, ends): one row for each prefix; ``above`` is the key of the prefix before, ``ends`` marks the whole."""
    schema = "conv_id long, depth int, key binary, above binary, n_words long, ends boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, held = None, None, None
        for batch in batches:
            out = []
            for conv, print_, words in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "print", "n_words"))):
                if held is not None:
                    out.append((*held, conv != last))
                if conv != last:
                    last, state = conv, hashlib.sha256()
                    held = (conv, 0, state.digest(), None, words)
                else:
                    state.update(print_)
                    held = (conv, held[1] + 1, state.digest(), held[2], words)
            if out:
                yield _prefix_batch(out)
        if held is not None:
            yield _prefix_batch([(*held, True)])

    return rebuilt.repartition("conv_id").sortWithinPartitions("conv_id", "at").select("conv_id", "print", "n_words").mapInArrow(run, schema)


def _prefix_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
    names = ["conv_id", "depth", "key", "above", "n_words", "ends"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def build(conversations: DataFrame, block: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Nodes and ends.

    Nodes: (key, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens), where ``conv_id`` is the smallest member; its
    turn number ``depth`` after rebuilding is the node's turn. Ends: (key, conv_id), the conversations whose last turn the node is.
    """
    spark = conversations.sparkSession
    base = work_path(spark, "trie")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.parquet(f"{base}/{name}")

    turns = stored(number_turns(fingerprints(conversations)), "turns")
    every = stored(prefixes(rebuild(turns, block, heads)), "prefixes")
    ends = every.where("ends").select("key", "conv_id")
    sequences = stored(ends.groupBy("key").agg(F.count("*").alias("weight"), F.min("conv_id").alias("conv_id")), "sequences")

    # rows of one member per distinct sequence; the others say the same
    weights = sequences.select("conv_id", "weight")
    single = stored(every.join(weights, "conv_id"), "single")
    inner = single.where(~F.col("ends")).select("key").distinct()
    leaves = sequences.join(inner, "key", "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    marked = stored(single.join(leaves, "conv_id", "left").withColumn("leaf", F.coalesce("leaf", F.lit(0))), "marked")

    nodes = stored(marked.groupBy("key").agg(
        F.count("*").alias("n"), F.first("depth").alias("depth"), F.first("above").alias("above"), F.first("n_words").alias("n_words"), F.min("conv_id").alias("low"),
        F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves")), "nodes")
    children = nodes.where("above IS NOT NULL").groupBy(F.col("above").alias("key")).agg(F.count("*").alias("n"))
    parents = stored(children.join(nodes.select("key", F.col("low").alias("parent")), "key"), "parents")

    met = look_up(marked.select("key", "conv_id", "depth"), nodes.select("key", "n", "low", "n_convs", "n_words"), ["key"])
    saved = F.when(F.col("low") == F.col("conv_id"), (F.col("n_convs") - 1) * F.col("n_words")).otherwise(0)
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    sums = met.select("key", F.sum(saved).over(below).alias("saved")).groupBy("key").agg(F.sum("saved").alias("saved_tokens"))

    whole = nodes.drop("n").join(sums, "key").join(parents.select("key", F.col("n").alias("n_children")), "key", "left")
    top = whole.where("above IS NULL").withColumn("parent", F.lit(None).cast("long"))
    rest = look_up(whole.where("above IS NOT NULL"), parents.select(F.col("key").alias("above"), "n", "parent"), ["above"]).drop("n")
    columns = ["key", F.col("depth").cast("long").alias("depth"), F.col("low").alias("conv_id"), F.col("parent").alias("parent_conv_id"), "n_convs",
               F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"), "saved_tokens"]
    return top.unionByName(rest).select(*columns), ends


def hash_ends(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): sha256 over a node's ending conversations, in ascending order and joined by commas.

    Ids are packed into texts by ranges first. The packs of a node stream through the hash in order; no list is ever whole.
    """
    pack = F.floor(F.col("conv_id") / PACK)
    packs = ends.groupBy("key", pack.alias("pack")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            keys, digests = [], []
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if key == last:
                    state.update(b"," + ids.encode())
                    continue
                if last is not None:
                    keys.append(last)
                    digests.append(state.hexdigest())
                last, state = key, hashlib.sha256(ids.encode())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], names=["key", "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["key", "ends_sha256"])

    return packs.repartition("key").sortWithinPartitions("key", "pack").select("key", "ids").mapInArrow(run, "key binary, ends_sha256 string")
