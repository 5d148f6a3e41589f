import datetime as dt
import decimal
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from plumbline.sources import catalog, excel, files, jdbc, kafka
from plumbline.streaming import cdc, live, sinks
from plumbline.workloads.relational import _workbook
from tests.conftest import rows


def test_csv_view(spark, tmp_path):
    path = str(tmp_path / "my city-list.v1.csv")
    (tmp_path / "my city-list.v1.csv").write_text("id,city,population\n1,New York,8000000\n2,London,9000000\n3,Tokyo,14000000\n")
    files.read_csv(spark, path)
    assert rows(spark.sql("SELECT city FROM my_city_list WHERE population > 8500000")) == [("London",), ("Tokyo",)]


def test_csv_is_split_unless_quotes_stay_open(spark, tmp_path):
    (tmp_path / "plain.csv").write_text("id,t\n" + "".join(f'{i},"a ""b"" {i}"\n' for i in range(5000)))
    (tmp_path / "broken.csv").write_text('id,t\n1,"first\nsecond"\n2,x\n')
    assert not files.has_open_quotes(spark, str(tmp_path / "plain.csv")) and files.has_open_quotes(spark, str(tmp_path / "broken.csv"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        plain = files.read_csv(spark, str(tmp_path / "plain.csv"))
        assert plain.rdd.getNumPartitions() > 3 and plain.count() == 5000 and plain.where("id = 7").first().t == 'a "b" 7'
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows(files.read_csv(spark, str(tmp_path / "broken.csv"))) == [(1, "first\nsecond"), (2, "x")]


def write_book(path, sheet, **parts):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>')
        for name, text in parts.items():
            book.writestr(f"xl/{name}.xml", text.replace("MAIN", main))


def test_excel(spark, tmp_path):
    df = spark.createDataFrame([(1, "Widget & co", 19.99), (2, "Gadget", 29.99)], "id long, product string, price double").withColumn("block", F.lit(0))
    packed = df.groupBy("block").applyInPandas(_workbook, "rows long, content binary")
    assert rows(excel.parse_workbooks(packed.select("content"), "id int, price double")) == [(1, 19.99), (2, 29.99)]
    assert rows(excel.parse_workbooks(packed.select("content"), "p_partkey int", sheet="notes")) == [(-1,)]
    (tmp_path / "books").mkdir()
    (tmp_path / "books/a.xlsx").write_bytes(packed.first().content)
    back = excel.read_excel(spark, str(tmp_path / "books"), "price double, id int, product string, absent string", "books")
    assert rows(back) == [(19.99, 1, "Widget & co", None), (29.99, 2, "Gadget", None)]
    assert spark.sql("SELECT product FROM books ORDER BY price DESC LIMIT 1").first()[0] == "Gadget"


def test_excel_cells(spark, tmp_path):
    """Shared texts, gaps, formulas, errors, booleans, both day counts, built-in and own date formats, exact longs."""
    styles = ('<styleSheet xmlns="MAIN"><numFmts><numFmt numFmtId="165" formatCode="[Red]0.00&quot;days&quot;"/><numFmt numFmtId="166" formatCode="dd/mm/yy hh:mm"/></numFmts>'
              '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="166"/><xf numFmtId="165"/></cellXfs></styleSheet>')
    head = "".join(f'<c t="s"><v>{i}</v></c>' for i in range(6))
    strings = '<sst xmlns="MAIN">' + "".join(f"<si><r><t>{w[0]}</t></r><r><t>{w[1:]}</t></r></si>" for w in ("day", "time", "plain", "flag", "key", "text")) + "</sst>"
    body = ('<row><c s="1"><v>45292</v></c><c s="2"><v>45292.75</v></c><c s="3"><v>45292.5</v></c><c t="b"><v>1</v></c><c><v>9007199254740993</v></c><c t="str"><f>A1</f><v>made</v></c></row>'
            '<row><c r="A3" s="1"><v>59</v></c><c r="C3" t="e"><v>#N/A</v></c><c r="D3" t="b"><v>0</v></c><c r="E3"><v>1.5E3</v></c></row>')
    write_book(tmp_path / "a.xlsx", f"<row>{head}</row>{body}", styles=styles, sharedStrings=strings)
    schema = "day date, time timestamp, plain double, flag boolean, key long, text string"
    day = dt.date
    assert excel.read_excel(spark, str(tmp_path), schema).orderBy("key").collect() == [
        (day(1900, 2, 28), None, None, False, 1500, None), (day(2024, 1, 1), dt.datetime(2024, 1, 1, 18), 45292.5, True, 9007199254740993, "made")]
    workbook = ('<workbook xmlns="MAIN" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><workbookPr date1904="1"/><sheets><sheet name="s" r:id="x"/></sheets></workbook>')
    (tmp_path / "old").mkdir()
    write_book(tmp_path / "old/b.xlsx", f"<row>{head}</row>{body}", styles=styles, sharedStrings=strings, workbook=workbook,
               **{"_rels/workbook.xml.rels": ""})
    with zipfile.ZipFile(tmp_path / "old/c.xlsx", "w") as out, zipfile.ZipFile(tmp_path / "old/b.xlsx") as given:
        for name in given.namelist():
            if "rels" not in name:
                out.writestr(name, given.read(name))
        out.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="x" Target="/xl/worksheets/sheet1.xml"/></Relationships>')
    (tmp_path / "old/b.xlsx").unlink()
    assert {r.day for r in excel.read_excel(spark, str(tmp_path / "old"), schema).collect()} == {day(2028, 1, 2), day(1904, 2, 29)}


def test_excel_faults(spark, tmp_path):
    write_book(tmp_path / "a.xlsx", '<row><c t="inlineStr"><is><t>n</t></is></c></row><row><c><v>7</v></c></row><row><c t="inlineStr"><is><t>seven</t></is></c></row><row><c><v>1.5</v></c></row>')
    read = lambda how: excel.read_excel(spark, str(tmp_path), "n int", on_fault=how)
    assert rows(read("null")) == [(7,), (None,), (None,)]
    assert sorted((r.n or 0, r.faults) for r in read("list").collect()) == [(0, ["n"]), (0, ["n"]), (7, [])]
    with pytest.raises(Exception, match="can't hold"):
        read("raise").collect()
    with pytest.raises(ValueError):
        read("guess")


def test_file_check_and_inventory(spark, tmp_path):
    (tmp_path / "a b.csv").write_text("x\n1\n")
    (tmp_path / "n.txt").write_text("no")
    ok, missing, other = (files.file_check(spark, str(tmp_path / n)).first() for n in ("a b.csv", "gone.csv", "n.txt"))
    assert (ok.success, missing.success, other.success) == (True, False, False)
    assert "File not found" in missing.message and "Unsupported" in other.message and ok.size_bytes == 4
    assert rows(files.file_inventory(spark, str(tmp_path)), "view_name", "extension", "size_bytes") == [("a_b", "csv", 4)]


def test_ndjson_text_forms(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 2, 3, 4, 5, 60), dt.date(2024, 1, 2), decimal.Decimal("1.50"), None)],
                               "i int, t timestamp, d date, m decimal(5,2), n string")
    files.write_ndjson(df, path)
    assert json.loads(spark.read.text(path).first()[0]) == {"i": 1, "t": "2024-01-02 03:04:05.000060", "d": "2024-01-02", "m": "1.50", "n": None}


def test_jdbc_options():
    got = jdbc.jdbc_options("PostgreSQL", "h", "db", table="t", partition_column="id", bounds=(0, 100), partitions=8, user="u")
    assert got["url"] == "jdbc:postgresql://h:5432/db" and got["fetchsize"] == "100" and got["numPartitions"] == "8" and got["user"] == "u"
    assert jdbc.jdbc_options("sqlserver", "h", "db", query="SELECT 1")["url"] == "jdbc:sqlserver://h:1433;databaseName=db"
    assert jdbc.jdbc_url("oracle", "h", "svc") == "jdbc:oracle:thin:@//h:1521/svc"
    for bad in [dict(table="t", query="q"), dict(), dict(table="t", partition_column="id")]:
        with pytest.raises(ValueError):
            jdbc.jdbc_options("mysql", "h", "db", **bad)
    with pytest.raises(ValueError):
        jdbc.canonical_kind("db2")


def test_connector_by_name(spark):
    from pyspark.sql.datasource import DataSource, DataSourceReader

    class Numbers(DataSource):
        @classmethod
        def name(cls):
            return "three_numbers"

        def schema(self):
            return "n int"

        def reader(self, schema):
            class Reader(DataSourceReader):
                def read(self, partition):
                    yield from [(1,), (2,), (3,)]

            return Reader()

    from plumbline.sources.registry import register_connector

    assert register_connector(spark, Numbers) == "three_numbers"
    assert rows(spark.read.format("three_numbers").load()) == [(1,), (2,), (3,)]
    with pytest.raises(TypeError):
        register_connector(spark, dict)


def test_metadata_schemas_parse(spark):
    from plumbline.schemas import SCHEMAS, empty

    assert all(empty(spark, name).count() == 0 for name in list(SCHEMAS)[:3])
    assert all(empty(spark, name).columns for name in SCHEMAS)


def test_kafka_options():
    assert kafka.kafka_options("b:1", "t", "g", max_offsets_per_trigger=5) == {
        "kafka.bootstrap.servers": "b:1", "subscribe": "t", "kafka.group.id": "g", "startingOffsets": "earliest", "maxOffsetsPerTrigger": "5"}


def test_catalog(spark):
    frames = {"a": spark.range(3), "b": spark.createDataFrame([(1, "x")], "k int, v string")}
    assert rows(catalog.list_columns(spark, frames, {"b": ["k"]}), "column_id", "data_type", "is_primary_key", "ordinal_position") == [
        ("a.id", "bigint", False, 1), ("b.k", "int", True, 1), ("b.v", "string", False, 2)]
    assert catalog.list_columns(spark, frames, metadata_limit=1).count() == 1
    assert rows(catalog.table_sizes(frames)) == [("a", 3), ("b", 1)]
    frames["a"].createOrReplaceTempView("cat_view_a")
    assert "cat_view_a" in {r.table_name for r in catalog.list_tables(spark).collect()}


def change(op, offset, key, value):
    row = {"id": key, "v": value}
    return json.dumps({"before": row if op != "i" else None, "after": row if op != "d" else None, "op": op, "feed_offset": offset})


def feed(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


def test_cdc_decode(spark):
    got = cdc.cdc_changes(feed(spark, [change("i", 1, 1, "a"), change("d", 2, 1, "a"), "not json"]), "id int, v string")
    assert rows(got) == [("d", 2, 1, "a"), ("i", 1, 1, "a")]


@pytest.mark.parametrize("compact_every", [1, 2, 50])
def test_cdc_state_is_idempotent_and_ignores_late_changes(spark, tmp_path, compact_every):
    table = cdc.CdcTable(spark, str(tmp_path / "state"), ["id"], compact_every)
    batches = [
        [change("i", 1, 1, "a"), change("i", 2, 2, "b"), change("u", 5, 1, "c")],
        [change("d", 6, 2, "b"), change("i", 7, 3, "x")],
        [change("u", 3, 2, "late"), change("u", 4, 1, "late"), change("u", 8, 3, "y")],
    ]
    decoded = [cdc.cdc_changes(feed(spark, b), "id int, v string") for b in batches]
    for i, b in enumerate(decoded):
        table.write_batch(b, i)
    once = rows(table.current())
    table.write_batch(decoded[2], 2)  # a retried batch
    assert once == rows(table.current()) == [(1, 5, "c"), (3, 8, "y")]


def test_rejects_say_why(spark):
    lines = [change("i", 1, 1, "a"), "not json", '{"op": "u"', '{"op": "z", "after": {"id": 1}}', '{"op": "u"}', '{"after": {"id": 1}}', change("u", 2, None, "b"), None]
    got = cdc.cdc_rejects(feed(spark, lines), "id int, v string", keys=["id"]).collect()
    assert sorted(r.reason for r in got) == sorted(
        ["not valid JSON of the declared row"] * 3 + ["unknown operation", "no row", "no operation", "no key id"]) and {r.value for r in got} == set(lines[1:])
    assert cdc.cdc_changes(feed(spark, lines), "id int, v string", keys=["id"]).count() == 1


def epoch_change(op, epoch, offset, key, value):
    return json.dumps(json.loads(change(op, offset, key, value)) | {"epoch": epoch})


def test_partitions_that_disagree_on_offsets(spark, tmp_path):
    """A key moves to a partition with smaller offsets: the later epoch wins, in one batch or over several, also after compaction."""
    batches = [[epoch_change("i", 0, 900, 1, "old"), epoch_change("i", 0, 901, 2, "old"), epoch_change("u", 1, 3, 1, "new")], [epoch_change("d", 1, 4, 2, "old"), epoch_change("u", 0, 950, 1, "late")]]
    for compact_every in (1, 2, 9):
        table = cdc.CdcTable(spark, str(tmp_path / f"state{compact_every}"), ["id"], compact_every, buckets=3)
        for i, lines in enumerate(batches):
            table.write_batch(cdc.cdc_changes(feed(spark, lines), "id int, v string", with_epoch=True), i)
        assert rows(table.current(), "id", "v") == [(1, "new")]


def test_only_touched_buckets_are_merged(spark, tmp_path):
    table = cdc.CdcTable(spark, str(tmp_path / "state"), ["id"], compact_every=2, buckets=8)
    decode = lambda lines: cdc.cdc_changes(feed(spark, lines), "id int, v string")
    for i in range(2):
        table.write_batch(decode([change("u", i * 100 + k, k, f"v{i}") for k in range(40)]), i)
    live = lambda: {r["bucket"]: r["folder"] for r in table.manifest() if r["kind"] != "merged"}
    first = live()
    assert set(first.values()) == {"bases/v1"} and len(first) == 8
    for i in (2, 3):
        table.write_batch(decode([change("u", i * 100, 7, f"w{i}")]), i)
    after = live()
    assert sorted(after.values()) == ["bases/v1"] * 7 + ["bases/v3"]
    want = [(k, "w3" if k == 7 else "v1") for k in range(40)]
    assert rows(table.current(), "id", "v") == sorted(want, key=str)
    table.write_batch(decode([change("u", 300, 7, "w3")]), 3)  # a retried batch
    assert rows(table.current(), "id", "v") == sorted(want, key=str)
    # what no version names any more goes, and nothing else
    gone = table.vacuum()
    assert any(g.endswith("deltas/v0") for g in gone) and not (tmp_path / "state/deltas/v0").exists() and not (tmp_path / "state/deltas/v3").exists()
    moved = next(b for b, f in after.items() if f == "bases/v3")
    assert not (tmp_path / f"state/bases/v1/{cdc.BUCKET}={moved}").exists() and (tmp_path / "state/bases/v1").exists()
    assert rows(table.current(), "id", "v") == sorted(want, key=str)
    table.write_batch(decode([]), 4)
    assert rows(table.current(), "id", "v") == sorted(want, key=str) and {r["version"] for r in table.manifest()} == {4}
    table.write_batch(decode([change("d", 900, 7, "w3"), change("u", 100, 8, "late")]), 5)
    assert rows(table.current(), "id", "v") == sorted([w for w in want if w[0] != 7], key=str)


def test_state_of_nothing(spark, tmp_path):
    table = cdc.CdcTable(spark, str(tmp_path / "state"), ["id"])
    assert table.manifest() == [] and table.vacuum() == []
    with pytest.raises(ValueError):
        table.current()


def test_faulty_messages_are_kept_apart(spark, tmp_path):
    source = tmp_path / "in"
    feed(spark, [change("i", 1, 1, "a"), "oops", change("i", 2, 2, "b")]).coalesce(1).write.text(str(source))
    table = cdc.apply_cdc(kafka.file_stream(spark, str(source)), ["id"], str(tmp_path / "s"), str(tmp_path / "cp"), row_schema="id int, v string", rejects_dir=str(tmp_path / "bad"))
    assert rows(table.current(), "id", "v") == [(1, "a"), (2, "b")]
    assert [r.value for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["oops"]


def test_stream_matches_batch_with_several_files(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    base = dt.datetime(2024, 1, 1)
    data = [(i, base + dt.timedelta(minutes=17 * i), "k" if i % 3 else "j", float(i * 7919 % 101)) for i in range(240)]
    df = spark.createDataFrame(data, "id int, ts timestamp, k string, v double")
    for i in range(3):  # time-ordered files, as a feed delivers them
        df.filter(f"id >= {i * 80} AND id < {i * 80 + 80}").coalesce(1).write.parquet(str(source / f"f{i}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option(
        "latestFirst", False).parquet(str(source))
    live.stream_anomalies(stream, "k", "ts", "v", str(tmp_path / "sums"), out, str(tmp_path / "cp1"), hours=5, threshold=1.2)
    batch = rows(live.rolling_anomalies(df, "k", "ts", "v", hours=5, threshold=1.2).select("id", F.round("z_score", 6), "is_anomaly"))
    assert rows(spark.read.parquet(out).select("id", F.round("z_score", 6), "is_anomaly")) == batch

    kpis = str(tmp_path / "kpis")
    sinks.run_available_now(live.live_kpis(stream, "ts", "k", "v", watermark="10 days"), sinks.batch_folder(kpis), str(tmp_path / "cp2"), "update")
    merged = sinks.latest_rows(spark.read.parquet(kpis), ["window_start", "window_end", "metric"])
    direct = df.groupBy(F.date_trunc("hour", "ts").alias("window_start"), F.col("k").alias("metric")).agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    assert rows(merged, "window_start", "metric", "n", "total") == rows(direct)


def test_rolling_state_is_bounded_and_repeats_count_once(spark, tmp_path):
    """Five micro-batches with repeats and a row far behind: scores are those of the batch form over the rows that count, the state stays small."""
    source, out, state = tmp_path / "in", str(tmp_path / "out"), tmp_path / "state"
    base = dt.datetime(2024, 1, 1)
    data = [(i, base + dt.timedelta(minutes=17 * i), "k" if i % 3 else "j", float(i * 7919 % 101)) for i in range(600)]
    schema = "id int, ts timestamp, k string, v double"
    for i in range(5):
        part = data[i * 120 : i * 120 + 120] + (data[i * 120 - 30 : i * 120] if i else []) + ([(9999, base, "k", 5000.0)] if i == 4 else [])
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(source / f"f{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
    live.stream_anomalies(stream, "k", "ts", "v", str(state), out, str(tmp_path / "cp"), hours=5, threshold=1.2, unique="id", lateness=10)
    scored = spark.read.parquet(out)
    assert scored.select("batch_id").distinct().count() == 5
    batch = live.rolling_anomalies(spark.createDataFrame(data, schema), "k", "ts", "v", hours=5, threshold=1.2)
    assert rows(scored, "id", F.round("z_score", 6), "is_anomaly") == rows(batch, "id", F.round("z_score", 6), "is_anomaly")
    assert len([f for f in state.iterdir() if not f.name.startswith(".")]) <= 3
    newest = max(state.iterdir(), key=lambda f: int(f.name[1:]) if f.name.startswith("v") else -1)
    assert spark.read.parquet(str(newest)).count() <= 2 * (34 + 9 + 5 + 10 + 2) < live.hourly_moments(spark.createDataFrame(data, schema), "k", "ts", "v").count()
    with pytest.raises(ValueError):
        live.stream_anomalies(stream, "k", "ts", "v", str(state), out, str(tmp_path / "cp2"), unique="id")


def test_late_rows_are_dropped_behind_the_watermark(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    base = dt.datetime(2024, 1, 2)
    schema = "ts timestamp, k string, v double"
    for i, (hours, n) in enumerate([(0, 5), (12, 5), (13, 1), (-12, 7)]):
        part = spark.createDataFrame([(base + dt.timedelta(hours=hours), "k", 1.0)] * n, schema)
        part.coalesce(1).write.parquet(str(source / f"f{i}"))
    out = str(tmp_path / "out")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
    sinks.run_available_now(live.live_kpis(stream, "ts", "k", "v", watermark="1 hour"), sinks.batch_folder(out), str(tmp_path / "cp"), "update")
    starts = {r.window_start for r in spark.read.parquet(out).collect()}
    assert base in starts and base - dt.timedelta(hours=12) not in starts


def test_threshold_and_mask_on_streams(spark, tmp_path):
    df = spark.createDataFrame([("s1", 5.0), ("s2", 50.0), ("s3", -1.0)], "ssn string, v double")
    assert rows(live.threshold_anomalies(df, "v", 0.0, 10.0), "ssn") == [("s2",), ("s3",)]
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    sinks.run_available_now(live.mask_stream(stream), sinks.batch_folder(str(tmp_path / "out")), str(tmp_path / "cp"))
    assert {r.ssn for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"****"}
