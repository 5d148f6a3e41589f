import pytest
from pyspark.sql import functions as F

from plumbline.functions import masks


def masked(spark, value, kind, params=None):
    df = spark.createDataFrame([(value,)], "v string")
    return tuple(df.select(masks.mask_column(F.col("v"), kind, params), masks.is_masked(F.col("v"), kind)).first())


@pytest.mark.parametrize("value, kind, expected", [
    ("user@example.com", "email", "use****@example.com"), ("abc@x.org", "email", "***@x.org"), ("abcd@x@y", "email", "abc****@x"),
    ("123-45-6789", "ssn", "***-**-6789"), ("4532-1111-2222-3333", "credit_card", "****-****-****-3333"),
    ("555-123-4567", "phone", "****-****-4567"), ("John Doe", "name", "J****"), ("anything", "generic", "****"), ("", "generic", "****")])
def test_masked_formats(spark, value, kind, expected):
    assert masked(spark, value, kind) == (expected, True)


@pytest.mark.parametrize("value, kind", [("no at sign", "email"), ("12345678", "ssn"), ("123", "phone"), ("123", "credit_card"), ("", "name"), ("x", "unknown"), (None, "generic"), ("x", None)])
def test_values_left_alone(spark, value, kind):
    assert masked(spark, value, kind) == (value, False)


def test_custom_and_hash(spark):
    assert masked(spark, "v", "custom", {"mask_pattern": "<gone>"}) == ("<gone>", True)
    assert masked(spark, "v", "hash")[0] == "4c94485e0c21ae6c41ce1dfe7b6bfaceea5ab68e40a2476f50208e526f506080"


@pytest.mark.parametrize("value, expected", [("abcd", "****"), ("abcde", "ab*de"), ("", "****"), (None, None)])
def test_partial(spark, value, expected):
    df = spark.createDataFrame([(value, value)], "Email_Home string, other string")
    assert tuple(masks.redact(df, "viewer").first()) == (expected, value)
    assert tuple(masks.redact(df, "admin").first()) == (value, value)


def test_stream_rule_masks_nulls_of_known_names(spark):
    df = spark.createDataFrame([(None, "x", 1)], "SSN string, ssn_code string, uid int")
    assert tuple(masks.redact_stream(df).first()) == ("****", "x", "****")


@pytest.mark.parametrize("role, expected", [("admin", "user@x.org"), ("analyst", "use****@x.org"), ("viewer", "***@***"), ("public", None)])
def test_roles(spark, role, expected):
    df = spark.createDataFrame([("user@x.org",)], "v string")
    assert df.select(masks.mask_by_role(F.col("v"), role)).first()[0] == expected
