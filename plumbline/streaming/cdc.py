"""Change feeds: decode, report what does not parse, and keep the current state of every key in buckets."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import exists, remove
from plumbline.streaming.sinks import run_available_now

# Operations of the envelope.
OPERATIONS = ("i", "u", "d")
BUCKET = "__bucket"
_LIVE = ("base", "delta")
_MANIFEST = "version long, bucket int, kind string, folder string"


def _parsed(feed: DataFrame, row_schema: str, value: str) -> tuple[DataFrame, T.StructType]:
    fields = T.StructType.fromDDL(row_schema)
    envelope = T.StructType([
        T.StructField("before", fields), T.StructField("after", fields), T.StructField("op", T.StringType()), T.StructField("feed_offset", T.LongType()),
        T.StructField("epoch", T.LongType()), T.StructField("__bad", T.StringType())])
    return feed.withColumn("__e", F.from_json(value, envelope, {"columnNameOfCorruptRecord": "__bad"})), fields


def _fault(row_keys: Sequence[str] = ()) -> Column:
    """Why a message is no change; NULL if it is one."""
    row = F.coalesce("__e.after", "__e.before")
    fault = F.when(F.col("__e.__bad").isNotNull() | F.col("__e").isNull(), "not valid JSON of the declared row")
    fault = fault.when(F.col("__e.op").isNull(), "no operation").when(~F.col("__e.op").isin(*OPERATIONS), "unknown operation").when(row.isNull(), "no row")
    for key in row_keys:
        fault = fault.when(row[key].isNull(), f"no key {key}")
    return fault


def cdc_changes(feed: DataFrame, row_schema: str, value: str = "value", keys: Sequence[str] = (), with_epoch: bool = False) -> DataFrame:
    """Flattens ``{"before": ..., "after": ..., "op": "u/i/d", "feed_offset": n}`` texts to change rows.

    A delete carries the fields of ``before``. Works on batches and streams. Messages that are no change (and, if ``keys`` are named,
    those without a key) are left out here and listed by :func:`cdc_rejects`. ``with_epoch`` adds ``epoch``, of the feed or the envelope, else 0.
    """
    parsed, fields = _parsed(feed, row_schema, value)
    row = F.coalesce("__e.after", "__e.before")
    columns = [F.col("__e.op").alias("op"), _of(feed, "feed_offset").alias("feed_offset"), *[row[f.name].alias(f.name) for f in fields.fields]]
    if with_epoch:
        columns.append(F.coalesce(_of(feed, "epoch"), F.lit(0)).cast("long").alias("epoch"))
    return parsed.filter(_fault(keys).isNull()).select(*columns)


def _of(feed: DataFrame, name: str) -> Column:
    return F.col(name) if name in feed.columns else F.col(f"__e.{name}")


def cdc_rejects(feed: DataFrame, row_schema: str, value: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """(value, reason) of the messages that :func:`cdc_changes` leaves out, with the feed's own columns beside them; batches and streams."""
    parsed, _ = _parsed(feed, row_schema, value)
    return parsed.withColumn("reason", _fault(keys)).filter("reason IS NOT NULL").drop("__e")


def _rank(changes: DataFrame) -> Column:
    """Offsets order the changes of one key within one epoch only."""
    return F.struct(*[c for c in ("epoch", "feed_offset") if c in changes.columns])


def _last_change(changes: DataFrame, keys: Sequence[str], *also: str) -> DataFrame:
    others = [c for c in changes.columns if c not in keys and c not in also]
    return changes.groupBy(*also, *keys).agg(F.max_by(F.struct(*others), _rank(changes)).alias("__c")).select(*also, *keys, "__c.*")


class CdcTable:
    """Current state in buckets by key hash: for each bucket one base and the deltas since, all Parquet in a shared folder.

    A batch writes the last change of each of its keys to the buckets they fall into, and then a manifest: the folders that make up the
    state of that version. A reader sees a version whole or not at all. Buckets with ``compact_every`` deltas are merged into a new
    base; the others keep their files. The merge takes the highest (epoch, offset): a topic's offsets order a key's changes only as long
    as the key stays in one partition, so a feed raises ``epoch`` whenever keys move (0 where it has none). Deletes stay as
    tombstones, so a late or replayed older change cannot bring a row back. Folders are named by batch id: a retried batch overwrites its own.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], compact_every: int = 50, buckets: int = 16):
        self.spark, self.path, self.keys, self.compact_every, self.buckets = spark, path.rstrip("/"), list(keys), compact_every, buckets

    def _manifests(self) -> DataFrame | None:
        """All manifest rows; None before the first batch."""
        folder = f"{self.path}/manifest"
        if not exists(self.spark, folder):
            return None
        return self.spark.read.schema(_MANIFEST).option("recursiveFileLookup", True).json(folder)

    def manifest(self, before: int | None = None) -> list:
        """(version, bucket, kind, folder) rows of the newest version, or of the newest one ``before`` another.

        A version has one base and less than ``compact_every`` deltas for each bucket.
        """
        known = self._manifests()
        if known is None:
            return []
        known = known if before is None else known.filter(F.col("version") < before)
        last = known.agg(F.max("version")).first()[0]
        return known.filter(F.col("version") == last).collect() if last is not None else []

    def write_batch(self, changes: DataFrame, batch_id: int) -> None:
        bucket, seen = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"), Observation()
        last = _last_change(changes.withColumn(BUCKET, bucket), self.keys, BUCKET).repartition(BUCKET)
        last.observe(seen, F.collect_set(BUCKET).alias("touched")).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/deltas/v{batch_id}")
        # a retried batch starts from the version before its own
        state = [(r["bucket"], r["kind"], r["folder"]) for r in self.manifest(before=batch_id) if r["kind"] in _LIVE]
        state += [(b, "delta", f"deltas/v{batch_id}") for b in sorted(seen.get.get("touched") or [])]
        deltas = Counter(b for b, kind, _ in state if kind == "delta")
        due = {b for b, n in deltas.items() if n >= self.compact_every}
        if due:
            base = f"bases/v{batch_id}"
            merged = _last_change(self._read([s for s in state if s[0] in due]), self.keys, BUCKET)
            merged.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/{base}")
            merged_now = [(b, "merged", f) for b, _, f in state if b in due and f == f"deltas/v{batch_id}"]  # named once, for vacuum
            state = [s for s in state if s[0] not in due] + [(b, "base", base) for b in sorted(due)] + merged_now
        rows = [(batch_id, *s) for s in state] or [(batch_id, -1, "empty", "")]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/v{batch_id}")

    def _read(self, state: Sequence[tuple]) -> DataFrame:
        """Rows of (bucket, kind, folder) entries. Each folder is read once, and only the named buckets of it."""
        folders: dict[str, list[int]] = {}
        for bucket, _, folder in state:
            folders.setdefault(folder, []).append(bucket)
        parts = []
        for folder, own in folders.items():
            root = f"{self.path}/{folder}"
            parts.append(self.spark.read.option("basePath", root).parquet(*[f"{root}/{BUCKET}={b}" for b in sorted(own)]))
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more, allowMissingColumns=True)
        return out

    def current(self) -> DataFrame:
        """Rows that exist after all applied batches; only buckets with deltas are merged, the others are read as they are."""
        held = [r for r in self.manifest() if r["kind"] in _LIVE]
        state = [(r["bucket"], r["kind"], r["folder"]) for r in held]
        if not state:
            raise ValueError(f"no batch has been applied to {self.path}")
        open_ = {b for b, kind, _ in state if kind == "delta"}
        settled, moving = [s for s in state if s[0] not in open_], [s for s in state if s[0] in open_]
        parts = ([self._read(settled)] if settled else []) + ([_last_change(self._read(moving), self.keys, BUCKET)] if moving else [])
        out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return out.filter("op <> 'd'").drop("op", "epoch", BUCKET)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes the files that none of the last ``keep`` versions names, and their manifests; returns the removed folders.

        Readers of older versions must be done by then.
        """
        known = self._manifests()
        if known is None:
            return []
        versions = sorted((r[0] for r in known.select("version").distinct().collect()), reverse=True)
        kept = set(versions[:keep])
        listed = known.filter("kind <> 'empty'").collect()
        entries = {(r["version"], r["bucket"], r["folder"]) for r in listed}
        needed = {(r["bucket"], r["folder"]) for r in listed if r["version"] in kept and r["kind"] in _LIVE}
        gone = sorted({f"{self.path}/{f}/{BUCKET}={b}" for _, b, f in entries if (b, f) not in needed})
        dead = sorted({f for _, _, f in entries} - {f for _, f in needed})
        gone = [g for g in gone if not any(g.startswith(f"{self.path}/{f}/") for f in dead)] + [f"{self.path}/{f}" for f in dead]
        gone += [f"{self.path}/manifest/v{v}" for v in versions if v not in kept]
        remove(self.spark, gone)
        return gone


def apply_cdc(
    feed: DataFrame, keys: Sequence[str], state_dir: str, checkpoint: str, compact_every: int = 50, row_schema: str | None = None, rejects_dir: str | None = None, buckets: int = 16,
) -> CdcTable:
    """Applies the available part of a change stream and returns its table.

    ``feed`` holds changes, or with ``row_schema`` the messages themselves; then what is no change is written below ``rejects_dir`` batch by batch.
    """
    table = CdcTable(feed.sparkSession, state_dir, keys, compact_every, buckets)

    def handle(batch: DataFrame, batch_id: int) -> None:
        if row_schema is None:
            table.write_batch(batch, batch_id)
            return
        batch.persist()
        try:
            if rejects_dir:
                cdc_rejects(batch, row_schema, keys=keys).write.mode("overwrite").parquet(f"{rejects_dir}/batch_id={batch_id}")
            table.write_batch(cdc_changes(batch, row_schema, keys=keys, with_epoch=True), batch_id)
        finally:
            batch.unpersist()

    run_available_now(feed, handle, checkpoint)
    return table
