import datetime as dt

import pytest

from plumbline.operators import policies as P
from tests.conftest import rows

POLICY = ("policy_id string, name string, sensitivity_level string, contains_pii_condition boolean, action_type string, "
          "mask_type string, mask_pattern string, allowed_roles array<string>, enabled boolean")
CLASS = ("table_id string, sensitivity_level string, contains_pii boolean, masking_enabled boolean, access_restricted boolean, "
         "allowed_roles array<string>")


@pytest.fixture(scope="module")
def world(spark):
    policies = spark.createDataFrame([
        ("any", "any", None, None, "mask", "generic", None, ["admin"], True),
        ("empty", "empty", "", None, "mask", "name", None, None, True),
        ("conf", "conf", "confidential", None, "mask", "email", None, [], True),
        ("pii", "pii", None, True, "restrict_access", None, None, ["admin", "dpo"], True),
        ("off", "off", None, None, "mask", "generic", None, None, False),
        ("both", "both", "restricted", False, "mask", "ssn", None, None, True)], POLICY)
    classes = spark.createDataFrame([
        ("c", "confidential", False, True, False, None), ("p", "restricted", True, False, True, []), ("r", "restricted", False, True, True, ["x"]),
        ("n", None, None, False, False, None)], CLASS)
    return policies, classes


def test_matching(world):
    policies, classes = world
    got = rows(P.match_policies(classes, policies), "table_id", "policy_id")
    assert got == sorted([("c", "any"), ("c", "empty"), ("c", "conf"), ("p", "any"), ("p", "empty"), ("p", "pii"),
                          ("r", "any"), ("r", "empty"), ("r", "both"), ("n", "any"), ("n", "empty")], key=str)
    assert ("p", "pii") not in rows(P.match_policies(classes, policies, ["dpo"]), "table_id", "policy_id")
    assert ("c", "any") not in rows(P.match_policies(classes, policies, ["admin"]), "table_id", "policy_id")


def test_masking_in_policy_order(spark, world):
    policies, classes = world
    df = spark.createDataFrame([("user@x.org", None), ("plain", "b")], "a string, b string")
    result = P.apply_policies(df, "c", classes, policies, ["admin"])  # leaves conf (email), then empty (name)
    assert sorted(map(tuple, result.df.collect()), key=str) == [("p****", "b****"), ("u****", None)]
    assert result.counts() == {"original_rows": 2, "masked_rows": 4, "access_level": "masked", "columns_masked": ["a", "b"]}


def test_denied_and_unclassified(spark, world):
    policies, classes = world
    df = spark.createDataFrame([("x",), ("y",)], "a string")
    denied = P.apply_policies(df, "p", classes, policies)
    assert denied.df.count() == 0
    assert denied.counts() == {"original_rows": 2, "masked_rows": 2, "access_level": "denied", "columns_masked": []}
    free = P.apply_policies(df, "unknown", classes, policies)
    assert len(free.df.collect()) == 2 and free.counts()["access_level"] == "full"


def test_compliance(spark, world):
    policies, classes = world
    tables = spark.createDataFrame([(t,) for t in ["c", "p", "r", "n", "zzz"]], "table_id string")
    got = {r.table_id: (r.compliant, r.violations) for r in P.policy_compliance(tables, classes, policies).collect()}
    assert got["p"] == (False, "PII detected but masking not enabled; Access restricted but no allowed roles defined")
    assert got["zzz"] == got["c"] == got["r"] == (True, "")
    only = policies.filter("policy_id = 'conf'")
    lacking = {r.table_id: r.violations for r in P.policy_compliance(tables, classes, only).collect()}
    assert lacking["p"].endswith("PII detected but no masking policy applies")


def test_audit_rows_append(spark, tmp_path):
    path = str(tmp_path / "audit")
    at = dt.datetime(2024, 1, 1)
    masked = {"original_rows": 3, "masked_rows": 2, "access_level": "masked", "columns_masked": ["a"]}
    P.append_audit(P.audit_record(spark, "u", "t", "SELECT 1", masked, at), path)
    P.append_audit(P.audit_record(spark, "u", "t", "SELECT 1", {**masked, "access_level": "denied"}, at), path)
    assert rows(spark.read.parquet(path), "action", "rows_returned", "denial_reason") == [
        ("access_denied", 0, "Restricted access policy enforced"), ("query_executed", 3, None)]


def test_counts_do_not_wait_for_ever(spark):
    """Without an action there is nothing to count, and the call says so."""
    df = spark.range(3).selectExpr("id", "'x' AS name")
    classes = spark.createDataFrame([("t", None, False, False, False, None)], CLASS)
    result = P.apply_policies(df, "t", classes, spark.createDataFrame([], POLICY))
    with pytest.raises(TimeoutError):
        result.counts(wait_seconds=0.5)
    result.df.collect()
    assert result.counts()["original_rows"] == 3
