import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.functions import detectors as D
from plumbline.functions import fixed_values as fixed
from plumbline.operators import pii
from plumbline.session import dealt
from tests.conftest import rows


def column(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v string")


@pytest.mark.parametrize("kind, values, expected", [
    ("email", ["user@example.com", "john.doe@company.co.uk", "support+team@domain.org", " USER@EXAMPLE.COM "], True),
    ("email", ["not.an.email", "missing@domain", "spaces in@email.com", "https://example.com/path", None, ""], False),
    ("ssn", ["123-45-6789", "999-00-0000", "000-00-0001"], True),
    ("ssn", ["12-25-2023"], False),
    ("credit_card", ["4532111122223333", "4532-1111-2222-3333", "4532 1111 2222 3333"], True),
    ("credit_card", ["2.0.4.1"], False),
    ("phone", ["555-123-4567", "(555) 123-4567", "+1-555-123-4567", "5551234567"], True),
    ("ipv4", ["10.0.0.1", "2.0.4.1"], True),
    ("pan", ["abcde1234f"], True),
    ("aadhaar", ["1234 5678 9012"], True),
    ("passport", ["AB1234567"], True),
])
def test_patterns(spark, kind, values, expected):
    got = [r[0] for r in column(spark, values).select(D.matches(F.col("v"), kind)).collect()]
    assert got == [expected] * len(values)


@pytest.mark.parametrize("text, high", [("a7k3m9x2z1", True), ("f9d2k5j8n3", True), ("randomstr123", True), ("aaaaaa", False), ("aaabbb", False), ("common", False)])
def test_entropy_words(spark, text, high):
    bits = column(spark, [text]).select(D.entropy(F.col("v"))).first()[0]
    assert (bits > 3.0) is high
    share = [text.count(c) / len(text) for c in set(text)]
    assert math.isclose(bits, -sum(p * math.log2(p) for p in share), abs_tol=1e-9)


def test_entropy_of_nothing(spark):
    assert [r[0] for r in column(spark, ["", None]).select(D.entropy(F.col("v"))).collect()] == [0.0, None]


@pytest.mark.parametrize("name, kind", [
    ("email_addr", "email"), ("HOTEL", "phone"), ("filename", "name"), ("company", "pan"), ("zip", "address"), ("api_key", "password"),
    ("card_number", "credit_card"), ("uid", "aadhaar"), ("quantity", None)])
def test_name_hints(spark, name, kind):
    assert column(spark, [name]).select(D.name_hint(F.col("v"))).first()[0] == kind


@pytest.mark.parametrize("name, data_type, found", [
    ("uuid_token", None, ("password", 0.6)), ("hash_pwd", "text", ("password", 0.7)), ("birth_at", "date", ("date_of_birth", 0.7)),
    ("dob", "text", None), ("plain", "date", None)])
def test_semantic_rules(spark, name, data_type, found):
    df = spark.createDataFrame([(name, data_type)], "n string, t string")
    got = df.select(D.semantic_kind(F.col("n"), F.col("t"))).first()[0]
    assert (tuple(got) if got else None) == found


def test_scan_combines_methods(spark):
    df = spark.createDataFrame([(f"u{i}@x.org", f"u{i}@y.org", i, "10.0.0.%d" % i) for i in range(5)],
                               "email string, contact string, n int, host string")
    got = {r.column_name: (r.pii_type, r.confidence, r.methods, r.sensitivity_level) for r in pii.scan_pii(df, "t").collect()}
    assert got == {
        "email": ("email", 1.0, ["column_name", "data_pattern"], "confidential"),
        "contact": ("email", 1.0, ["data_pattern"], "confidential"),
        "host": ("ipv4", 1.0, ["data_pattern"], "internal")}


def test_first_pattern_wins_ties(spark):
    counts = pii.best_pattern(pii.pattern_counts(spark.createDataFrame([("c", "5551234567"), ("c", "10.0.0.1")], "k string, value string"), ["k"]))
    assert tuple(counts.select("pii_type", "hits", "confidence").first()) == ("phone", 1, 0.6)


def test_free_text_prefilter_loses_nothing(spark):
    samples = ["mail a@b.co now", "call 555-123-4567", "id 1234 5678 9012", "ABCDE1234F", "at 1.2.3.4", "AB123456", "plain words", "v1.2", None, ""]
    df = spark.createDataFrame(list(enumerate(samples)), "id int, text string")
    fast = rows(pii.text_pii_hits(df, "id", "text"))
    every = df.select("id", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), D.text_hits(F.col("text"), k).cast("long").alias("n")) for k in fixed.VALUE_PATTERNS])))
    assert fast == rows(every.filter("n > 0"))
    assert {r[0] for r in fast} == {0, 1, 2, 3, 4, 5}


def test_entropy_counts_whole_characters(spark):
    """Against plain counts: characters of one to four bytes, texts without any next to others, nulls, an empty table."""
    texts = ["", "a", None, "abcabc", "h\u00e9llo w\u00f6rld", "\u65e5\u672c\u65e5\u672c\u8a9e", "\U0001f600\U0001f600x", "zyxwv", "", "ab" * 5000]
    plain = lambda t: t and -sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values())
    for given in (texts, texts * 300, []):
        got = [r[0] for r in column(spark, given).coalesce(1).select(D.entropy(F.col("v"))).collect()]
        assert got == [pytest.approx(plain(t) or 0.0) if t is not None else None for t in given]


def test_scan_deals_rows_to_tasks(spark):
    """Rows of one task, as a small file gives them, are tested in many: values are counted by several tasks."""
    one = column(spark, [f"user{i}@example.com" for i in range(4000)]).coalesce(1)
    assert dealt(one).rdd.getNumPartitions() > one.rdd.getNumPartitions() == 1
    found = pii.scan_pii(one, "t").collect()
    assert [(r["column_name"], r["pii_type"]) for r in found] == [("v", "email")]
    assert "RoundRobinPartitioning" in pii.scan_pii(one, "t")._jdf.queryExecution().toString()
