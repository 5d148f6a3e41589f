"""Policy matching, enforcement, compliance and audit rows."""

from __future__ import annotations

import datetime as dt
import threading
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as fixed
from plumbline.functions.masks import is_masked, mask_column

ANY = "*"


def active_policies(policies_df: DataFrame, roles: Sequence[str]) -> DataFrame:
    """Enabled policies none of whose bypass roles the user holds."""
    held = F.array(*[F.lit(r) for r in roles]).cast("array<string>")
    bypassed = F.coalesce(F.arrays_overlap(F.col("allowed_roles"), held), F.lit(False))
    return policies_df.filter(F.col("enabled") & ~bypassed)


def _level_key(level: Column) -> Column:
    return F.when(F.coalesce(level, F.lit("")) == "", F.lit(ANY)).otherwise(level)


def _pii_key(flag: Column) -> Column:
    return F.coalesce(flag.cast("string"), F.lit(ANY))


def classification_keys(level: Column, pii: Column) -> Column:
    """The (level, pii) keys a policy may carry to cover a classification: exact or any, four in all."""
    levels = F.array_distinct(F.array(F.coalesce(level, F.lit("")), F.lit(ANY)))
    flags = F.array_distinct(F.array(F.coalesce(pii.cast("string"), F.lit(ANY)), F.lit(ANY)))
    return F.flatten(F.transform(levels, lambda l: F.transform(flags, lambda p: F.concat_ws("|", l, p))))


def _keyed_policies(policies_df: DataFrame, roles: Sequence[str]) -> DataFrame:
    key = F.concat_ws("|", _level_key(F.col("sensitivity_level")), _pii_key(F.col("contains_pii_condition")))
    return active_policies(policies_df, roles).select(key.alias("__key"), "policy_id", "action_type")


def policy_counts(policies_df: DataFrame, roles: Sequence[str]) -> DataFrame:
    """Active policies counted per key. There are as many keys as level/flag combinations."""
    return _keyed_policies(policies_df, roles).groupBy("__key").agg(
        F.count_if(F.col("action_type") == "mask").alias("n_mask"), F.count(F.lit(1)).alias("n_policies"))


def match_policies(classifications_df: DataFrame, policies_df: DataFrame, roles: Sequence[str] = ()) -> DataFrame:
    """(table_id, policy_id, action_type) for every policy that covers a classification.

    A null-tolerant match is turned into an equi-join: a classification probes at most four keys.
    """
    probes = classifications_df.select(
        "table_id", F.explode(classification_keys(F.col("sensitivity_level"), F.col("contains_pii"))).alias("__key"))
    return probes.join(_keyed_policies(policies_df, roles), "__key").select("table_id", "policy_id", "action_type")


def policy_compliance(
    tables_df: DataFrame, classifications_df: DataFrame, policies_df: DataFrame, sep: str = "; "
) -> DataFrame:
    """Violations per table; a table without classification is compliant."""
    probes = classifications_df.select(
        "table_id", F.explode(classification_keys(F.col("sensitivity_level"), F.col("contains_pii"))).alias("__key"))
    covered = (
        probes.join(policy_counts(policies_df, ()), "__key")
        .groupBy("table_id")
        .agg(F.sum("n_mask").alias("n_mask"), F.sum("n_policies").alias("n_policies"))
    )
    joined = (
        tables_df.select("table_id").distinct()
        .join(classifications_df.withColumn("__known", F.lit(True)), "table_id", "left")
        .join(covered, "table_id", "left")
    )
    pii = F.coalesce(F.col("contains_pii"), F.lit(False))
    no_roles = F.coalesce(F.size("allowed_roles") <= 0, F.lit(True))
    violations = F.array_compact(F.array(
        F.when(pii & ~F.coalesce(F.col("masking_enabled"), F.lit(False)), fixed.VIOLATION_UNMASKED),
        F.when(F.coalesce(F.col("access_restricted"), F.lit(False)) & no_roles, fixed.VIOLATION_NO_ROLES),
        F.when(pii & (F.coalesce(F.col("n_mask"), F.lit(0)) == 0), fixed.VIOLATION_NO_POLICY),
    ))
    return joined.select(
        "table_id",
        (F.size(violations) == 0).alias("compliant"),
        F.array_join(violations, sep).alias("violations"),
        F.coalesce(F.col("n_policies"), F.lit(0)).alias("policies_applied"),
    )


class GovernedResult:
    """Result of :func:`apply_policies`.

    The counts come from an observation, so they exist once ``df`` has been written or collected.
    A refused result has no rows to observe: its withheld rows are counted on request.
    """

    def __init__(self, df, policies, withheld, observation, columns):
        self.df, self.policies, self.denied = df, policies, withheld is not None
        self._withheld, self._observation, self._columns = withheld, observation, columns

    def counts(self, wait_seconds: float = 60.0) -> dict:
        """Rows and masked values of the action that has run on ``df``; raises ``TimeoutError`` where none has."""
        if self.denied:
            rows = self._withheld.count()
            return {"original_rows": rows, "masked_rows": rows, "access_level": "denied", "columns_masked": []}
        seen = _within(wait_seconds, lambda: self._observation.get)
        masked = sum(seen.get(f"m{i}") or 0 for i in range(len(self._columns)))
        return {
            "original_rows": seen["rows"],
            "masked_rows": masked,
            "access_level": "masked" if masked else "full",
            "columns_masked": [c for i, c in enumerate(self._columns) if seen.get(f"m{i}")],
        }


def _within(seconds: float, read: Callable[[], dict]) -> dict:
    """The value of a call that may never return."""
    got: list = []
    reader = threading.Thread(target=lambda: got.append(read()), daemon=True)
    reader.start()
    reader.join(seconds)
    if not got:
        raise TimeoutError("no action has run on the governed rows yet: write or collect them first")
    return got[0]


DEFAULT_MASK = "generic"


def _with_mask(policies_df: DataFrame) -> DataFrame:
    """Mask type and pattern of each policy.

    ``action_params`` (a map) tells apart a policy without parameters, which masks as :data:`DEFAULT_MASK`, from parameters that
    name no type, which mask nothing. Flat ``mask_type`` columns can't; there, no type means the default too.
    """
    if "action_params" in policies_df.columns:
        params = F.col("action_params")
        kind, pattern = F.when(params.isNull(), DEFAULT_MASK).otherwise(F.try_element_at(params, F.lit("mask_type"))), F.try_element_at(params, F.lit("mask_pattern"))
    else:
        kind, pattern = F.coalesce("mask_type", F.lit(DEFAULT_MASK)), F.col("mask_pattern")
    return policies_df.select("policy_id", "name", kind.alias("mask_type"), pattern.alias("mask_pattern"))


def apply_policies(
    df: DataFrame,
    table_id: str,
    classifications_df: DataFrame,
    policies_df: DataFrame,
    roles: Sequence[str] = (),
    columns: Sequence[str] | None = None,
    max_policies: int = 10_000,
) -> GovernedResult:
    """Enforces the policies that cover ``table_id`` on a query result.

    The policies of one table decide the shape of the plan, so they are fetched first (an error is
    raised beyond ``max_policies``). Masking is then a projection, and masked values are
    counted by an observation on the same pass. ``columns`` limits masking to those columns.
    """
    mine = classifications_df.filter(F.col("table_id") == table_id)
    matched = match_policies(mine, policies_df, roles).join(
        _with_mask(policies_df), "policy_id")
    rows = matched.orderBy("policy_id").limit(max_policies + 1).collect()
    if len(rows) > max_policies:
        raise ValueError(f"more than {max_policies} policies cover table {table_id}")
    denied = any(r["action_type"] == "restrict_access" for r in rows)
    observation = Observation(f"policies-{uuid.uuid4().hex}")
    names = [r["name"] for r in rows]
    targets = list(columns if columns is not None else df.columns)
    if denied:
        return GovernedResult(df.limit(0), names, df, observation, targets)
    kinds = [(r["mask_type"], r["mask_pattern"]) for r in rows if r["action_type"] == "mask" and r["mask_type"]]
    if not kinds:
        watched = df.observe(observation, F.count(F.lit(1)).alias("rows"))
        return GovernedResult(watched, names, None, observation, targets)
    # one projection per policy: nesting the masks in one expression would double it at every step
    tallies = {c: f"__m{i}" for i, c in enumerate(targets)}
    staged = df.select("*", *[F.lit(0).alias(n) for n in tallies.values()])
    for kind, pattern in kinds:
        params = {"mask_pattern": pattern} if pattern else None
        staged = staged.select(
            *[mask_column(F.col(f"`{c}`"), kind, params).alias(c) if c in tallies else F.col(f"`{c}`") for c in df.columns],
            *[(F.col(n) + is_masked(F.col(f"`{c}`"), kind).cast("int")).alias(n) for c, n in tallies.items()],
        )
    watched = staged.observe(observation, F.count(F.lit(1)).alias("rows"),
                             *[F.sum(F.col(n)).alias(f"m{i}") for i, n in enumerate(tallies.values())])
    return GovernedResult(watched.select(*[F.col(f"`{c}`") for c in df.columns]), names, None, observation, targets)


def audit_record(
    spark, user_id: str, table_id: str, query: str, counts: dict, at: dt.datetime, policies: Sequence[str] = (), execution_time_ms: int | None = None
) -> DataFrame:
    """One audit row for a governed query; ``execution_time_ms`` is what the caller measured around it."""
    level = counts["access_level"]
    row = (
        uuid.uuid4().hex, user_id, "access_denied" if level == "denied" else "query_executed", "table", table_id, query,
        0 if level == "denied" else counts["original_rows"], 0 if level == "denied" else counts["masked_rows"],
        list(counts["columns_masked"]), level, fixed.DENIAL_REASON if level == "denied" else None, at, execution_time_ms,
    )
    return spark.createDataFrame([row], (
        "audit_id string, user_id string, action string, resource_type string, resource_id string, "
        "query_executed string, rows_returned long, rows_masked long, columns_masked array<string>, "
        "access_level string, denial_reason string, timestamp timestamp, execution_time_ms long"))


def append_audit(record: DataFrame, path: str) -> None:
    record.write.mode("append").parquet(path)

