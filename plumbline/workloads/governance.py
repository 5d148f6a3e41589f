"""Registered jobs: sensitive data, masking, policies, audit and telemetry."""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import functions as F

from plumbline.functions import detectors as D
from plumbline.functions import fixed_values as fixed
from plumbline.functions import masks
from plumbline.operators import pii, policies, telemetry
from plumbline.operators.profiling import as_text
from plumbline.session import dealt, work_path
from plumbline.sources.tables import load
from plumbline.workloads import derived as V

CONTACT_COLUMNS = ["segment", "contact", "phone", "code1", "code2", "doc_no", "mixed", "aadhaar_no", "session_key",
                   "company", "notes"]


def _contacts(spark, sf):
    return V.frame(spark, sf, V.CONTACTS)


def _columns(spark, sf):
    return V.stored(spark, sf, V.CATALOG_COLUMNS)


def pii_name_hints(spark, sf):
    return _columns(spark, sf).select("column_id", "name", D.name_hint(F.col("name")).alias("pii_type")).filter(
        F.col("pii_type").isNotNull())


def pii_semantic(spark, sf):
    kind = D.semantic_kind(F.col("name"), F.col("data_type"))
    return _columns(spark, sf).select("column_id", kind.alias("k")).filter(F.col("k").isNotNull()).select(
        "column_id", F.col("k.kind").alias("pii_type"), F.col("k.confidence").alias("confidence"))


def _all_values(spark, sf):
    contacts = _contacts(spark, sf).select(*CONTACT_COLUMNS)
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), as_text(contacts.schema[c]).alias("value"))
                      for c in CONTACT_COLUMNS])
    return dealt(contacts).select(F.inline(cells)).filter(F.col("value").isNotNull())


def pii_value_patterns(spark, sf):
    """Every row value is tested, not only the frequent ones."""
    scored = pii.best_pattern(pii.pattern_counts(_all_values(spark, sf), ["column_name"]))
    return scored.filter(F.col("pii_type").isNotNull()).select(
        "column_name", "n_values", "hits", "pii_type", F.round("confidence", 6).alias("confidence"))


def value_entropy(spark, sf):
    return pii.value_entropy(_all_values(spark, sf), ["column_name"]).select(
        "column_name", F.round("avg_entropy", 5).alias("avg_entropy"))


def pii_combined(spark, sf):
    return pii.scan_pii(_contacts(spark, sf).select(*CONTACT_COLUMNS), "contacts").withColumn(
        "methods", F.array_join("methods", ","))


def pii_scan_summary(spark, sf):
    columns = _columns(spark, sf)
    found = pii.detect_columns(columns, None, ["column_id"])
    named = columns.select(F.col("table_id").alias("table_name"), F.col("column_id").alias("column_name"))
    hits = named.join(found.select(F.col("column_id").alias("column_name")), "column_name")
    return pii.scan_summary(hits, named)


def documents_pii_hits(spark, sf):
    return pii.text_pii_hits(load(spark, sf, "documents"), "doc_id", "text")


def mask_formats(spark, sf):
    contacts = _contacts(spark, sf)
    return contacts.select("c_custkey", *[
        masks.mask_column(F.col(col), kind).alias(f"{col}_{kind}")
        for col, kind in [("contact", "email"), ("mixed", "email"), ("code1", "ssn"), ("code2", "credit_card"),
                          ("phone", "phone"), ("mixed", "phone"), ("company", "name"), ("mixed", "name"),
                          ("notes", "generic"), ("code1", "generic"), ("company", "unknown")]
    ])


def mask_partial(spark, sf):
    contacts = _contacts(spark, sf).select(
        "c_custkey", F.col("contact").alias("work_email"), "phone", F.col("code1").alias("ssn_code"),
        F.col("mixed").alias("card_mixed"), "company")
    return masks.redact(contacts, "analyst")


def mask_stream_rule(spark, sf):
    contacts = _contacts(spark, sf).select(
        "c_custkey", F.col("contact").alias("email"), F.col("code1").alias("SSN"), F.col("phone").alias("phones"), "aadhaar_no")
    return masks.redact_stream(contacts)


def mask_by_role(spark, sf):
    return _contacts(spark, sf).select(
        "c_custkey", *[masks.mask_by_role(F.col("contact"), r).alias(r) for r in ("admin", "analyst", "viewer", "public")])


def mask_hash(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", masks.mask_column(F.col("c_name"), "hash").alias("c_name"))


def _policies(spark, sf):
    return V.frame(spark, sf, V.POLICIES).withColumns({
        "allowed_roles": F.split("bypass_roles", ","),
        "action_params": F.when(F.col("mask_type").isNotNull(), F.create_map(F.lit("mask_type"), F.col("mask_type")))})


def _classifications(spark, sf):
    return V.frame(spark, sf, V.CLASSIFICATIONS).withColumn("allowed_roles", F.split("allowed_roles", ","))


def policy_match(spark, sf):
    return policies.match_policies(_classifications(spark, sf), _policies(spark, sf), ["steward", "intern"])


def policy_compliance(spark, sf):
    tables = load(spark, sf, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("table_id"))
    return policies.policy_compliance(tables, _classifications(spark, sf), _policies(spark, sf))


def _governed(spark, sf, roles, only_mask):
    rules = _policies(spark, sf)
    if only_mask:
        rules = rules.filter(F.col("action_type") == "mask")
    contacts = _contacts(spark, sf).select("c_custkey", "contact", "phone", "code1", "company")
    return policies.apply_policies(contacts, "C0", _classifications(spark, sf), rules, roles)


def policy_apply_mask(spark, sf):
    """Masks whole rows of the contact table under the policies that cover one classified table."""
    return _governed(spark, sf, [], True).df


def policy_apply_denied(spark, sf):
    """Outcome of a refused request: no rows, everything counted as masked."""
    result = _governed(spark, sf, [], False)
    returned = result.df.count()
    counts = result.counts()
    return spark.createDataFrame(
        [(counts["access_level"], counts["original_rows"], counts["masked_rows"], returned)],
        "access_level string, original_rows long, masked_rows long, returned_rows long")


def audit_append(spark, sf):
    """Governed read followed by its audit row, written and read back."""
    result = _governed(spark, sf, [], True)
    began = time.monotonic()
    result.df.write.mode("overwrite").parquet(work_path(spark, "governed"))
    took = int(1000 * (time.monotonic() - began))
    path = work_path(spark, "audit")
    policies.append_audit(policies.audit_record(spark, "u1", "C0", "SELECT * FROM contacts", result.counts(),
                                                dt.datetime(2024, 2, 1), execution_time_ms=took), path)
    return spark.read.parquet(path).select("user_id", "action", "resource_id", "rows_returned", "rows_masked",
                                           F.array_join(F.array_sort("columns_masked"), ",").alias("columns_masked"),
                                           "access_level", (F.col("execution_time_ms") > 0).alias("is_timed"))


def runtime_metrics(spark, sf):
    log = load(spark, sf, "events").select("ts", "event_id", (F.col("value") / 1000).alias("duration_s"),
                                           (F.col("event_type") != "error").alias("ok"))
    return telemetry.runtime_metrics(log, "ts", "duration_s", "ok", ties=["event_id"])


def audit_report(spark, sf):
    return telemetry.audit_report(V.frame(spark, sf, V.AUDIT_LOG), "logged_at", dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20))


def connection_uptime(spark, sf):
    return telemetry.uptime(V.frame(spark, sf, V.HEALTH_LOG)).select(
        "connection_id", "checks", F.round("uptime_pct", 4).alias("uptime_pct"))


def request_durations(spark, sf):
    """Durations by event type; of the approximate 95th percentile, at most 96 % of the rows lie below and at least 94 % at or below."""
    events = load(spark, sf, "events")
    found = telemetry.durations(events, ["event_type"], "value")
    ranks = events.join(found.select("event_type", "p95"), "event_type").groupBy("event_type").agg(
        F.count_if(F.col("value") < F.col("p95")).alias("below"), F.count_if(F.col("value") <= F.col("p95")).alias("upto"))
    return found.join(ranks, "event_type").select(
        "event_type", "n", F.round("sum_value", 2).alias("sum_value"), "le_10", "le_50", "le_100", "le_500",
        ((F.col("below") <= 0.96 * F.col("n")) & (F.col("upto") >= 0.94 * F.col("n"))).alias("p95_holds"))


_CONTACTS = V.duck(V.CONTACTS)
_COLUMNS = V.duck(V.CATALOG_COLUMNS)


def _hint_case(name: str) -> str:
    return "CASE " + " ".join(
        f"WHEN regexp_matches(lower({name}), '{'|'.join(words)}') THEN '{kind}'" for kind, words in fixed.NAME_HINTS.items()
    ) + " END"


def _semantic_case(name: str, kind: str, what: str) -> str:
    hits = [(f"contains(lower({name}), 'uuid') AND contains(lower({name}), 'token')", "'password'", "0.6"),
            (f"contains(lower({name}), 'hash') AND (contains(lower({name}), 'password') OR contains(lower({name}), 'pwd'))", "'password'", "0.7"),
            (f"contains(lower({kind}), 'date') AND (contains(lower({name}), 'birth') OR contains(lower({name}), 'dob'))", "'date_of_birth'", "0.7")]
    return "CASE " + " ".join(f"WHEN {c} THEN {t if what == 'type' else v}" for c, t, v in hits) + " END"


def _cells(cols) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value FROM {_CONTACTS} WHERE {c} IS NOT NULL" for c in cols)


def _pattern_counts(values: str) -> str:
    tests = ", ".join(
        f"count(*) FILTER (WHERE trim(value) NOT IN ('', 'None') AND regexp_matches(trim(value), '(?i){p}')) AS {k}"
        for k, p in fixed.VALUE_PATTERNS.items())
    kinds = list(fixed.VALUE_PATTERNS)
    best = "CASE " + " ".join(f"WHEN {k} = greatest({', '.join(kinds)}) THEN '{k}'" for k in kinds) + " END"
    return (f"SELECT column_name, n_values, greatest({', '.join(kinds)}) AS hits, {best} AS pii_type, "
            f"round(least(1.0::DOUBLE, greatest({', '.join(kinds)})::DOUBLE / n_values * 1.2), 6) AS confidence FROM "
            f"(SELECT column_name, count(*) AS n_values, {tests} FROM {values} GROUP BY 1) WHERE greatest({', '.join(kinds)}) > 0")


def _entropy(values: str) -> str:
    return (f"SELECT column_name, avg(e) AS avg_entropy FROM (SELECT column_name, rid, "
            f"sum(CASE WHEN c IS NULL THEN 0 ELSE -(n / len::DOUBLE) * log2(n / len::DOUBLE) END) AS e FROM "
            f"(SELECT column_name, rid, c, any_value(length(value)) AS len, count(*) AS n FROM "
            f"(SELECT column_name, rid, value, unnest(CASE WHEN value = '' THEN [NULL] ELSE string_split(value, '') END) AS c FROM "
            f"(SELECT *, row_number() OVER () AS rid FROM {values})) GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1")


_ALL = f"({_cells(CONTACT_COLUMNS)})"


def _email_mask(c: str) -> str:
    return (f"CASE WHEN contains({c}, '@') THEN CASE WHEN length(split_part({c}, '@', 1)) > 3 "
            f"THEN substr({c}, 1, 3) || '****@' || split_part({c}, '@', 2) "
            f"ELSE repeat('*', length(split_part({c}, '@', 1))) || '@' || split_part({c}, '@', 2) END ELSE {c} END")


def _tail_mask(c: str, head: str, least: int) -> str:
    return f"CASE WHEN length({c}) >= {least} THEN '{head}' || right({c}, 4) ELSE {c} END"


def _name_mask(c: str) -> str:
    return f"CASE WHEN length({c}) > 0 THEN substr({c}, 1, 1) || '****' ELSE {c} END"


def _generic(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN '****' END"


def _partial(c: str) -> str:
    return (f"CASE WHEN length({c}) <= 4 THEN '****' WHEN {c} IS NOT NULL THEN substr({c}, 1, 2) || "
            f"repeat('*', length({c}) - 4) || right({c}, 2) END")


_MATCH_ON = """(coalesce(p.sensitivity_level, '') = '' OR p.sensitivity_level = c.sensitivity_level)
   AND (p.contains_pii_condition IS NULL OR p.contains_pii_condition = c.contains_pii)"""


def _applies(x: str) -> str:
    return (f"CAST(coalesce(CASE p.k WHEN 'email' THEN contains({x}, '@') WHEN 'ssn' THEN length({x}) >= 9 WHEN 'credit_card' THEN length({x}) >= 4 "
            f"WHEN 'phone' THEN length({x}) >= 4 WHEN 'name' THEN length({x}) > 0 WHEN 'generic' THEN {x} IS NOT NULL END, false) AS INTEGER)")


def _stepped(x: str) -> str:
    return (f"CASE p.k WHEN 'email' THEN {_email_mask(x)} WHEN 'ssn' THEN {_tail_mask(x, '***-**-', 9)} WHEN 'credit_card' THEN {_tail_mask(x, '****-****-****-', 4)} "
            f"WHEN 'phone' THEN {_tail_mask(x, '****-****-', 4)} WHEN 'name' THEN {_name_mask(x)} WHEN 'generic' THEN {_generic(x)} ELSE {x} END")


# the policies of table C0 applied one after the other, with a count of masked values per column
_MASK_WALK = f"""
WITH RECURSIVE p AS (SELECT coalesce(mask_type, 'generic') AS k, row_number() OVER (ORDER BY policy_id) AS o
   FROM {V.duck(V.CLASSIFICATIONS)} c JOIN {V.duck(V.POLICIES)} p ON {_MATCH_ON}
   WHERE c.table_id = 'C0' AND p.enabled AND p.action_type = 'mask'),
w AS (SELECT 0::BIGINT AS o, c_custkey::VARCHAR AS a, contact AS b, phone AS c, code1 AS d, company AS e,
   0 AS na, 0 AS nb, 0 AS nc, 0 AS nd, 0 AS ne FROM {_CONTACTS}
  UNION ALL SELECT p.o, {', '.join(_stepped('w.' + x) for x in 'abcde')}, {', '.join(f'w.n{x} + ' + _applies('w.' + x) for x in 'abcde')}
  FROM w JOIN p ON p.o = w.o + 1)"""


QUERIES = {
    "pii_name_hints": pii_name_hints,
    "pii_semantic": pii_semantic,
    "pii_value_patterns": pii_value_patterns,
    "value_entropy": value_entropy,
    "pii_combined": pii_combined,
    "pii_scan_summary": pii_scan_summary,
    "documents_pii_hits": documents_pii_hits,
    "mask_formats": mask_formats,
    "mask_partial": mask_partial,
    "mask_stream_rule": mask_stream_rule,
    "mask_by_role": mask_by_role,
    "mask_hash": mask_hash,
    "policy_match": policy_match,
    "policy_compliance": policy_compliance,
    "policy_apply_mask": policy_apply_mask,
    "policy_apply_denied": policy_apply_denied,
    "audit_append": audit_append,
    "runtime_metrics": runtime_metrics,
    "audit_report": audit_report,
    "connection_uptime": connection_uptime,
    "request_durations": request_durations,
}

ORACLES = {
    "pii_name_hints": f"SELECT column_id, name, {_hint_case('name')} AS pii_type FROM {_COLUMNS} WHERE {_hint_case('name')} IS NOT NULL",
    "pii_semantic": f"SELECT column_id, {_semantic_case('name', 'data_type', 'type')} AS pii_type, "
        f"({_semantic_case('name', 'data_type', 'conf')})::DOUBLE AS confidence FROM {_COLUMNS} "
        f"WHERE {_semantic_case('name', 'data_type', 'type')} IS NOT NULL",
    "pii_value_patterns": _pattern_counts(f"({_cells(CONTACT_COLUMNS)})"),
    "value_entropy": f"SELECT column_name, round(avg_entropy, 5) AS avg_entropy FROM ({_entropy('(' + _cells(CONTACT_COLUMNS) + ')')})",
    "pii_combined": f"""
WITH cols AS (SELECT unnest({CONTACT_COLUMNS!r}) AS column_name),
found AS (
  SELECT column_name, 1 AS o, 'column_name' AS method, {_hint_case('column_name')} AS t, 0.85::DOUBLE AS c FROM cols
  UNION ALL SELECT column_name, 2, 'data_pattern', pii_type, confidence FROM ({_pattern_counts(_ALL)})
  UNION ALL SELECT column_name, 3, 'entropy', 'password', 0.7 FROM ({_entropy(_ALL)}) WHERE avg_entropy > 4.5
  UNION ALL SELECT column_name, 4, 'semantic', {_semantic_case('column_name', "'string'", 'type')}, {_semantic_case('column_name', "'string'", 'conf')} FROM cols),
hits AS (SELECT *, first_value(t) OVER (PARTITION BY column_name ORDER BY c DESC, o) AS bt, first_value(c) OVER (PARTITION BY column_name ORDER BY c DESC, o) AS bc FROM found WHERE t IS NOT NULL)
SELECT 'contacts' AS table_name, column_name, bt AS pii_type, round(least(1.0::DOUBLE, bc + 0.05 * (count(*) FILTER (WHERE t = bt) - 1)), 6) AS confidence,
   string_agg(method, ',' ORDER BY o) AS methods,
   CASE WHEN bt IN ('ssn', 'credit_card', 'password', 'passport', 'pan', 'aadhaar') THEN 'restricted'
        WHEN bt IN ('email', 'phone', 'name') THEN 'confidential' ELSE 'internal' END AS sensitivity_level
FROM hits GROUP BY column_name, bt, bc""",
    "pii_scan_summary": f"""
WITH c AS (SELECT table_id AS table_name, coalesce({_hint_case('name')}, {_semantic_case('name', 'data_type', 'type')}) IS NOT NULL AS hit FROM {_COLUMNS})
SELECT table_name, count(*) AS columns_scanned, count(*) FILTER (WHERE hit) AS pii_columns,
       count(DISTINCT CASE WHEN hit THEN table_name END) AS tables_with_pii FROM c GROUP BY ROLLUP (table_name)""",
    "documents_pii_hits": " UNION ALL ".join(
        f"SELECT doc_id AS id, '{k}' AS pii_type, CAST(len(regexp_extract_all(text, '(?i){p}')) AS BIGINT) AS n_hits FROM documents "
        f"WHERE len(regexp_extract_all(text, '(?i){p}')) > 0" for k, p in D.FREE_TEXT_PATTERNS.items()),
    "mask_formats": f"""
SELECT c_custkey, {_email_mask('contact')} AS contact_email, {_email_mask('mixed')} AS mixed_email,
   {_tail_mask('code1', '***-**-', 9)} AS code1_ssn, {_tail_mask('code2', '****-****-****-', 4)} AS code2_credit_card,
   {_tail_mask('phone', '****-****-', 4)} AS phone_phone, {_tail_mask('mixed', '****-****-', 4)} AS mixed_phone,
   {_name_mask('company')} AS company_name, {_name_mask('mixed')} AS mixed_name, {_generic('notes')} AS notes_generic,
   {_generic('code1')} AS code1_generic, company AS company_unknown FROM {_CONTACTS}""",
    "mask_partial": f"SELECT c_custkey, {_partial('contact')} AS work_email, {_partial('phone')} AS phone, {_partial('code1')} AS ssn_code, "
        f"{_partial('mixed')} AS card_mixed, company FROM {_CONTACTS}",
    "mask_stream_rule": f"SELECT c_custkey, '****' AS email, '****' AS \"SSN\", phone AS phones, '****' AS aadhaar_no FROM {_CONTACTS}",
    "mask_by_role": f"SELECT c_custkey, contact AS admin, {_email_mask('contact')} AS analyst, '***@***' AS viewer, "
        f"CAST(NULL AS VARCHAR) AS public FROM {_CONTACTS}",
    "mask_hash": "SELECT c_custkey, sha256(c_name) AS c_name FROM customer",
    "policy_match": f"""
SELECT c.table_id, p.policy_id, p.action_type FROM {V.duck(V.CLASSIFICATIONS)} c JOIN {V.duck(V.POLICIES)} p ON {_MATCH_ON}
WHERE p.enabled AND NOT coalesce(list_has_any(string_split(p.bypass_roles, ','), ['steward', 'intern']), false)""",
    "policy_compliance": f"""
WITH m AS (SELECT c.table_id, count(*) AS n, count(*) FILTER (WHERE p.action_type = 'mask') AS nm
   FROM {V.duck(V.CLASSIFICATIONS)} c JOIN {V.duck(V.POLICIES)} p ON {_MATCH_ON} WHERE p.enabled GROUP BY 1),
j AS (SELECT 'C' || c_custkey AS table_id, c.*, coalesce(m.n, 0) AS n, coalesce(m.nm, 0) AS nm FROM customer
   LEFT JOIN {V.duck(V.CLASSIFICATIONS)} c ON c.table_id = 'C' || c_custkey LEFT JOIN m ON m.table_id = 'C' || c_custkey),
v AS (SELECT table_id, n, concat_ws('; ', CASE WHEN contains_pii AND NOT masking_enabled THEN '{fixed.VIOLATION_UNMASKED}' END,
   CASE WHEN access_restricted AND allowed_roles IS NULL THEN '{fixed.VIOLATION_NO_ROLES}' END,
   CASE WHEN contains_pii AND nm = 0 THEN '{fixed.VIOLATION_NO_POLICY}' END) AS violations FROM j)
SELECT table_id, violations = '' AS compliant, violations, n AS policies_applied FROM v""",
    "policy_apply_mask": f"{_MASK_WALK} SELECT a AS c_custkey, b AS contact, c AS phone, d AS code1, e AS company FROM w WHERE o = (SELECT count(*) FROM p)",
    "audit_append": f"""{_MASK_WALK}
SELECT 'u1' AS user_id, 'query_executed' AS action, 'C0' AS resource_id, count(*) AS rows_returned, CAST(sum(na + nb + nc + nd + ne) AS BIGINT) AS rows_masked,
  concat_ws(',', CASE WHEN sum(na) > 0 THEN 'c_custkey' END, CASE WHEN sum(nd) > 0 THEN 'code1' END, CASE WHEN sum(ne) > 0 THEN 'company' END,
    CASE WHEN sum(nb) > 0 THEN 'contact' END, CASE WHEN sum(nc) > 0 THEN 'phone' END) AS columns_masked,
  CASE WHEN sum(na + nb + nc + nd + ne) > 0 THEN 'masked' ELSE 'full' END AS access_level, true AS is_timed FROM w WHERE o = (SELECT count(*) FROM p)""",
    "policy_apply_denied": "SELECT 'denied' AS access_level, count(*) AS original_rows, count(*) AS masked_rows, CAST(0 AS BIGINT) AS returned_rows FROM customer",
    "runtime_metrics": """
WITH last AS (SELECT value / 1000 AS d FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000)
SELECT count(*) AS total_queries, round(100.0 * count(*) FILTER (WHERE event_type = 'error') / count(*), 4) AS error_rate,
   (SELECT CAST(floor(avg(d) * 1000) AS BIGINT) FROM last) AS avg_latency_ms,
   CASE WHEN count(*) FILTER (WHERE event_type = 'error') < count(*) * 0.1 THEN 'HEALTHY' ELSE 'DEGRADED' END AS status FROM events""",
    "audit_report": f"""
SELECT count(*) FILTER (WHERE action = 'query_executed') AS total_queries, count(*) FILTER (WHERE access_level = 'masked') AS pii_access_events,
   count(*) FILTER (WHERE access_level = 'denied') AS violations,
   CASE WHEN count(*) FILTER (WHERE access_level = 'denied') = 0 THEN 'COMPLIANT' ELSE 'NON_COMPLIANT' END AS status
FROM {V.duck(V.AUDIT_LOG)} WHERE logged_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'""",
    "connection_uptime": f"SELECT connection_id, count(*) AS checks, round(100.0 * count(*) FILTER (WHERE status = 'healthy') / count(*), 4) AS uptime_pct "
        f"FROM {V.duck(V.HEALTH_LOG)} GROUP BY 1",
    "request_durations": "SELECT event_type, count(*) AS n, round(sum(value), 2) AS sum_value, "
        + ", ".join(f"count(*) FILTER (WHERE value <= {b}) AS le_{b}" for b in (10, 50, 100, 500)) + ", true AS p95_holds FROM events GROUP BY 1",
}
