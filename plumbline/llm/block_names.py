"""Exact duplicates by deterministic block naming: equal texts get equal integers, different texts different ones. Column functions only.

1. Each text is cut into blocks of ``block`` bytes. The distinct blocks are sorted inside hash partitions and numbered: a block's name is its
   place. No name depends on a fingerprint being free of collisions.
2. Blocks are looked up by a 128-bit key instead of by their bytes. The table of distinct blocks shows whether two blocks share a key; if
   so, the keys are drawn again with another seed, so key equality is block equality.
3. Neighbouring names form pairs, and the distinct pairs are sorted and named in turn, until one name is left of each text. Texts that need
   equally many rounds are equal if and only if their last names are; the round and the name are the text's identity.

Texts cross the network once, as distinct blocks after map-side grouping; every later round moves integers, and half as many each time. A
block, pair or identity that a ten-thousandth of all rows share is looked up in a broadcast table, which therefore has less than ten
thousand rows; the others are joined by shuffle. Each round is a table in the shared folder, so a lost executor costs one round at most, and
names never change between their uses.

Results: a null text counts as empty, and empty texts equal each other. Of equal texts the row with the largest id stays, a null id being
smaller than any other; rows with that same id are told apart by their place in the first stored table, and one of them stays. An empty
table gives no rows. Extra columns pass through, whatever their type; columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import let
from plumbline.session import work_path

BLOCK = 1024
#: A key with more than this share of all rows goes through a broadcast table, which has fewer rows than its inverse.
HOT_SHARE = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_PARTNER = -1
SEEDS = 16


def find_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None, block: int = BLOCK, key_bits: int = 128) -> DataFrame:
    """The input with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` (of the text with A-Z lowered).

    ``carry`` names the input columns that the result needs, all by default. ``key_bits`` shortens the keys; a test uses it to see that
    clashing keys are drawn again.
    """
    spark = docs.sparkSession
    base = work_path(spark, "blocks")
    normal = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    blocks = docs.select(F.explode(_cut(normal, block)).alias("block"))
    seed = _name_blocks(blocks, f"{base}/names0", key_bits)

    made = {"keep_id", "group_size", "kept", "text_sha256", "__row", "__id", "__keys"}
    own = [c for c in docs.columns if c.lower() not in made and (carry is None or c in carry)]
    docs.select(*[F.col(f"`{c}`") for c in own], F.monotonically_increasing_id().alias("__row"), F.col(doc_id).alias("__id"), F.sha2(normal, 256).alias("text_sha256"),
                F.transform(_cut(normal, block), lambda b: _key(b, seed, key_bits)).alias("__keys")).write.parquet(f"{base}/rows")
    rows = spark.read.parquet(f"{base}/rows")
    symbols = rows.select("__row", F.posexplode("__keys").alias("at", "key"), F.size("__keys").alias("left"))
    look_up(symbols, spark.read.parquet(f"{base}/names0"), ["key"]).select("__row", "at", "left", "name").write.parquet(f"{base}/symbols0")

    found, level = None, 0
    while True:
        current = spark.read.parquet(f"{base}/symbols{level}")
        done = current.where("left = 1").select("__row", F.lit(level).alias("level"), "name")
        found = done if found is None else found.union(done)
        going = current.where("left > 1")
        if going.isEmpty():
            break
        level += 1
        _name_pairs(going, base, level)
    found.join(rows.select("__row", "__id"), "__row").write.parquet(f"{base}/identities")
    identities = spark.read.parquet(f"{base}/identities")
    # structs compare field by field and a null is the smallest value; of rows with one id the first stored one wins
    best = F.max(F.struct(F.col("__id").alias("id"), (-F.col("__row")).alias("row")))
    identities.groupBy("level", "name").agg(best.alias("best"), F.count("*").alias("n")).write.parquet(f"{base}/groups")
    verdicts = look_up(identities, spark.read.parquet(f"{base}/groups"), ["level", "name"]).select(
        "__row", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("best.row") == -F.col("__row")).alias("kept"))
    return rows.join(verdicts, "__row").select(*[F.col(f"`{c}`") for c in own], "keep_id", "group_size", "kept", "text_sha256")


def _cut(normal: Column, block: int) -> Column:
    """Consecutive blocks of bytes, the last one shorter; one empty block for an empty text."""
    def pieces(raw: Column) -> Column:
        last = F.greatest(F.floor((F.length(raw) - 1) / block), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * block + 1, block))
    return let(normal.cast("binary"), pieces)


def _key(value: Column, seed: int, bits: int) -> Column:
    """Two seeded 64-bit hashes; fewer bits on request."""
    low, high = F.xxhash64(F.lit(2 * seed), value), F.xxhash64(F.lit(2 * seed + 1), value)
    if bits < 64:
        return F.struct(low.bitwiseAND((1 << bits) - 1).alias("low"), F.lit(0).cast("long").alias("high"))
    return F.struct(low.alias("low"), (high if bits >= 128 else F.lit(0).cast("long")).alias("high"))


def _numbered(distinct: DataFrame, by: list[str]) -> DataFrame:
    """Names of distinct values: their place within their sorted partition."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def _name_blocks(blocks: DataFrame, path: str, bits: int) -> int:
    """Stores (key, n, name) of the distinct blocks and returns the seed under which no two of them share a key."""
    spark = blocks.sparkSession
    distinct = _numbered(blocks.groupBy("block").agg(F.count("*").alias("n")), ["block"])
    if bits >= 128:
        distinct.select(_key(F.col("block"), 0, bits).alias("key"), "n", "name").write.parquet(path)
        if not _clash(spark.read.parquet(path)):
            return 0
    distinct.write.parquet(path + "-blocks")
    for seed in range(1, SEEDS):
        spark.read.parquet(path + "-blocks").select(_key(F.col("block"), seed, bits).alias("key"), "n", "name").write.mode("overwrite").parquet(path)
        if not _clash(spark.read.parquet(path)):
            return seed
    raise RuntimeError(f"no seed below {SEEDS} gives distinct blocks distinct keys of {bits} bits")


def _clash(names: DataFrame) -> bool:
    return not names.groupBy("key").count().where("count > 1").isEmpty()


def _name_pairs(symbols: DataFrame, base: str, level: int) -> None:
    """One round: neighbours become pairs, distinct pairs are named, and each text holds half as many names."""
    spark = symbols.sparkSession
    half = F.shiftright("at", 1)
    side = F.col("at").bitwiseAND(1)
    symbols.groupBy("__row", half.alias("at"), F.shiftright(F.col("left") + 1, 1).alias("left")).agg(
        F.max(F.when(side == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(side == 1, F.col("name"))), F.lit(NO_PARTNER)).alias("b"),
    ).write.parquet(f"{base}/pairs{level}")
    pairs = spark.read.parquet(f"{base}/pairs{level}")
    _numbered(pairs.groupBy("a", "b").agg(F.count("*").alias("n")), ["a", "b"]).write.parquet(f"{base}/names{level}")
    look_up(pairs, spark.read.parquet(f"{base}/names{level}"), ["a", "b"]).select("__row", "at", "left", "name").write.parquet(f"{base}/symbols{level}")


def look_up(rows: DataFrame, table: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """Each row that has an entry in ``table`` with that entry; ``table`` has one entry for each key, and the key's number of rows in ``count``.

    Entries with more than one row in ``HOT_SHARE`` are fewer than ``HOT_SHARE``; they are broadcast, so a hot key meets no shuffle.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * HOT_SHARE > total
    many = F.broadcast(table.where(hot))
    return rows.join(many, keys).unionByName(rows.join(F.broadcast(table.where(hot).select(*keys)), keys, "left_anti").join(table.where(~hot), keys))
