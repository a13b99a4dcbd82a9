"""Sources, staging sync, SQL models, delivery, quality gate, helpers and streaming."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from kiln.operators import delivery as D
from kiln.operators import quality as Q
from kiln.plans import helpers as H
from kiln.plans.spec import Field, Mapping, Standard
from kiln.session import shared_dir
from kiln.sources.attach import attach_source, list_source_tables
from kiln.sources.model import model_inputs, run_model
from kiln.sources.ods import bulk_copy, sync_to_ods
from kiln.sources.standard_csv import merge_standards, read_standard_csv, standards_from_frame
from tests.conftest import SF001


def uid():
    return uuid.uuid4().hex[:8]


def test_sync_to_ods_statuses(spark):
    pat = spark.createDataFrame([(1, "a", 30), (2, "b", None), (3, "c", 40)], "patient_id int not null, patient_name string not null, patient_age int")
    sid = f"his{uid()}"
    res = {r.table_name: r for r in sync_to_ods(spark, sid, {"patients": pat, "admissions": None}).collect()}
    assert res["patients"].status == "success" and res["patients"].rows_copied == 3
    assert res["admissions"].status == "skipped"
    back = spark.table(f"ods_{sid}.patients")
    assert back.count() == 3 and all(f.nullable for f in back.schema.fields)


def test_sync_failure_does_not_stop_others(spark):
    bad = spark.range(3).select((F.lit(1) / F.lit(0)).alias("x"))  # ANSI: division by zero at run time
    res = {r.table_name: r.status for r in sync_to_ods(spark, f"s{uid()}", {"bad": bad, "good": spark.range(2)}).collect()}
    assert res == {"bad": "failed", "good": "success"}


def test_attach_folder_source(spark):
    views = attach_source(spark, {"id": "tpch", "format": "parquet", "path": SF001}, ["nation", "region", "absent_table"])
    assert views == ["src_tpch_nation", "src_tpch_region"]
    assert spark.table("src_tpch_region").count() == 5
    assert "orders" in list_source_tables(spark, {"format": "parquet", "path": SF001})


def test_jdbc_round_trip_with_embedded_derby(spark):
    # embedded, in-memory Derby in the driver JVM: no server, no port (local mode only)
    url = f"jdbc:derby:memory:kiln{uid()};create=true"
    src = {"id": "his", "format": "jdbc", "url": url, "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    df = spark.read.parquet(f"{SF001}/nation.parquet")
    n = bulk_copy(df, {**src, "dbtable": "NATION"}, batch_size=10)
    assert n == 25
    assert "APP.NATION" in list_source_tables(spark, src)
    views = attach_source(spark, src, ["NATION"])
    got = spark.table(views[0]).filter(F.col("n_regionkey") == 1)
    assert got.count() == 5
    assert "PushedFilters: [*IsNotNull(n_regionkey), *EqualTo(n_regionkey,1)]" in got._jdf.queryExecution().executedPlan().toString()


def test_jdbc_reads_in_partitions_and_schemas_keep_apart(spark):
    from kiln.sources.attach import read_source_table
    from kiln.sources.ods import sync_source

    url = f"jdbc:derby:memory:kiln{uid()};create=true"
    src = {"id": f"his{uid()}", "format": "jdbc", "url": url, "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    df = spark.read.parquet(f"{SF001}/orders.parquet").select("o_orderkey", "o_orderstatus")
    bulk_copy(df, {**src, "dbtable": "HR.ORDERS", "numPartitions": 2})
    bulk_copy(df.limit(7), {**src, "dbtable": "SALES.ORDERS"})
    part = read_source_table(spark, src, "HR.ORDERS", {"partitionColumn": '"o_orderkey"', "numPartitions": 4})
    assert part.rdd.getNumPartitions() == 4 and part.count() == df.count()
    views = attach_source(spark, src)
    assert [v.removeprefix(f"src_{src['id']}_") for v in views] == ["hr_orders", "sales_orders"]
    res = {r.table_name: (r.status, r.rows_copied) for r in sync_source(spark, src, table_options={"HR.ORDERS": {"partitionColumn": '"o_orderkey"'}}).collect()}
    assert res == {"HR.ORDERS": ("success", df.count()), "SALES.ORDERS": ("success", 7)}
    assert sync_source(spark, src, ["orders"]).first().status == "failed"  # which one?


def test_same_names_in_a_folder_source(spark):
    root = shared_dir(spark, "two", uid())
    for name, n in (("hr.orders", 3), ("sales.orders", 7)):
        spark.range(n).write.parquet(f"{root}/{name}.parquet")
    from kiln.sources.ods import sync_source

    res = sync_source(spark, {"id": f"f{uid()}", "format": "parquet", "path": root})
    assert sorted((r.table_name, r.rows_copied) for r in res.collect()) == [("hr.orders", 3), ("sales.orders", 7)]


def test_csv_source_with_declared_schema(spark):
    root = shared_dir(spark, "csv", uid())
    spark.range(3).selectExpr("id", "id * 2 AS v").write.option("header", True).csv(f"{root}/t.csv")
    from kiln.sources.attach import read_source_table

    df = read_source_table(spark, {"format": "csv", "path": root, "schemas": {"t": "id long, v decimal(9,2)"}}, "t")
    assert df.schema["v"].dataType.simpleString() == "decimal(9,2)" and df.count() == 3


def test_old_reader_finishes_after_a_new_delivery(spark):
    db = f"prod{uid()}"
    for deliver in (D.deliver_atomic, D.deliver_replace):
        name = deliver.__name__
        deliver(spark.range(1000), db, name)
        reader = spark.table(f"{db}.{name}")
        plan = reader.selectExpr("sum(id) AS s")
        deliver(spark.range(5), db, name)
        assert plan.first().s == 999 * 500  # the version before is still there
        assert spark.table(f"{db}.{name}").count() == 5
        deliver(spark.range(6), db, name)
        assert spark.table(f"{db}.{name}").count() == 6


def test_failed_replace_leaves_the_old_table(spark):
    db = f"prod{uid()}"
    D.deliver_replace(spark.range(3), db, "t")
    with pytest.raises(Exception):
        D.deliver_replace(spark.range(3).select(F.raise_error(F.lit("no")).alias("x")), db, "t")
    assert spark.table(f"{db}.t").count() == 3


def test_standard_csv(spark, tmp_path):
    p = tmp_path / "std.csv"
    p.write_text(
        "module,table_name,table_comment,field_name,field_type,field_comment,example\n"
        "m, admissions ,Admissions,subject_id,INTEGER NOT NULL,patient,1\n"
        "m,patients,Patients,subject_id,  INTEGER not null  ,id,2\n"
        "m,admissions,ignored,admittime,TIMESTAMP NOT NULL,time,\n",
        encoding="utf-8",
    )
    std = standards_from_frame(read_standard_csv(spark, str(p)))
    assert [s.table for s in std] == ["admissions", "patients"]
    assert [len(s.fields) for s in std] == [2, 1]
    assert std[0].description == "Admissions"
    assert std[0].fields[1].data_type == "TIMESTAMP" and not std[0].fields[1].nullable
    merged = merge_standards(read_standard_csv(spark, str(p)).filter("table_name = 'admissions'"), read_standard_csv(spark, str(p)))
    assert [s.table for s in standards_from_frame(merged)] == ["admissions", "patients"]


def test_run_model_inputs(spark):
    sql = "SELECT count(*) AS n FROM {{ source('tpch', 'nation') }} WHERE n_regionkey = :r"
    assert model_inputs(sql) == [("tpch", "nation")]
    nation = spark.read.parquet(f"{SF001}/nation.parquet")
    assert run_model(spark, sql, {("tpch", "nation"): nation}, args={"r": 1}).first().n == 5
    with pytest.raises(LookupError):
        run_model(spark, sql.replace("nation", "planet"), {("tpch", "nation"): nation}, args={"r": 1})


def test_delivery_strategies(spark):
    db = f"prod{uid()}"
    v1 = spark.range(3)
    v2 = spark.range(5)
    assert D.deliver_atomic(v1, db, "t") == 3
    assert D.deliver_atomic(v2, db, "t") == 5  # the switch replaces the view; the old version stays for one cycle
    assert spark.table(f"{db}.t").count() == 5
    versions = [t.name for t in spark.catalog.listTables(db) if t.name.startswith("t__v")]
    assert len(versions) == 2  # the new version and the one before it
    assert D.deliver_replace(v1, db, "t") == 3  # replace after atomic: the view becomes a table
    assert spark.table(f"{db}.t").count() == 3
    assert D.deliver_atomic(v2, db, "t") == 5  # and back


def test_deliver_results_and_summary(spark):
    db = f"prod{uid()}"
    res = D.deliver(spark, {"clean_a": spark.range(4), "clean_b": "no_db.no_table", "plain": spark.range(2)}, "replace", db)
    rows = {r.clean_table: r for r in res.collect()}
    assert rows["clean_a"].prod_table == "a" and rows["clean_a"].rows == 4
    assert rows["clean_b"].status == "failed" and rows["plain"].status == "success"
    s = D.delivery_summary(res).first()
    assert (s.tables, s.succeeded, s.failed, s.total_rows, s.status) == (3, 2, 1, 6, "partial")
    bad = D.deliver(spark, {"clean_a": spark.range(1)}, "teleport", db).first()
    assert bad.status == "error"
    dry = D.deliver(spark, {"clean_a": spark.range(1)}, "atomic", db, dry_run=True).first()
    assert dry.status == "planned"
    copy_root = shared_dir(spark, "copy", uid())
    c = D.deliver(spark, {"clean_c": spark.range(7)}, "copy", db, copy_root=copy_root).first()
    assert (c.status, c.rows) == ("success", 7)


def test_quality_and_gate(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "id int, name string")
    report = Q.qc_report(
        [Q.check_not_null(df, ["id", "name"], "t"), Q.check_unique(df, ["id", "name"], "t"), Q.check_custom(df, "pos", "id > 0", "t")]
    )
    got = {r.check_name: (r.failures, r.status) for r in report.collect()}
    assert got["not_null_t_name"] == (1, "fail") and got["unique_t_id"] == (1, "fail")
    assert got["unique_t_name"] == (0, "pass") and got["pos"] == (0, "pass")
    assert not H.qc_gate(report)
    with pytest.raises(RuntimeError):
        H.require_gate(report)
    t = Q.qc_totals(report).first()
    assert (t.passed, t.failed, t.gate_open) == (3, 2, False)


def test_helpers(spark):
    std = Standard("p", (Field("id", "INTEGER", False, constraints=("unique",)), Field("n", "TEXT")))
    r = H.rules_from_standard(std)
    assert r.not_null == ("id",) and r.unique == ("id",)
    maps = [Mapping("a", "direct", "x.patients", "id"), Mapping("b", "transform", "x.visits", "v"), Mapping("c", "direct", "x.visits", "w")]
    assert H.primary_source(maps) == "x.visits"
    maps_df = spark.createDataFrame(
        [("a", "direct", "x.patients", "id"), ("b", "direct", "visits", "nope"), ("c", "direct", "ghosts", "g"), ("d", "missing", None, None)],
        "target_field string, kind string, source_table string, source_field string",
    )
    catalog = spark.createDataFrame(
        [("his", 0, "patients", "id"), ("his", 0, "visits", "v"), ("emr", 1, "visits", "nope")],
        "source_id string, source_order int, table_name string, column_name string",
    )
    errors = [r.error for r in H.check_mappings(maps_df, catalog).orderBy("n").collect()]
    assert errors == ["field not found: visits.nope", "table not found in any source: ghosts"]
    used = H.used_sources(maps_df.withColumn("target_table", F.lit("t")), catalog.select("source_id", "source_order", "table_name").distinct())
    assert [(r.source_id, r.tables) for r in used.collect()] == [("his", ["patients", "visits"])]
    meta = H.column_metadata(spark.createDataFrame([], "a decimal(10,2), b string")).collect()
    assert (meta[0].precision, meta[0].scale) == (10, 2)
    assert H.filter_confidence([Mapping("a", confidence=0.5), Mapping("b", confidence=0.95)], 0.9)[0].target == "b"


def test_run_history_compare(spark):
    path = shared_dir(spark, "hist", uid())
    for run, v in ((1, 5), (2, 2)):
        D.append_history(spark, path, spark.createDataFrame([("chk", v)], "item string, value long"), run, "check")
    rows = D.compare_runs(spark.read.parquet(path)).orderBy("run_id").collect()
    assert [(r.value, r.previous_value, r.change) for r in rows] == [(5, None, None), (2, 5, -3)]


def test_stream_clean_mask_dedup(spark):
    from kiln.plans.spec import CleanRule
    from kiln.streaming.clean_stream import clean_stream, file_stream, write_available

    schema = spark.read.parquet(f"{SF001}/events.parquet").schema
    stream = file_stream(spark, SF001, schema, glob="events.parquet")
    out = clean_stream(
        stream,
        [CleanRule("event_type", ("trim_whitespace", "uppercase"))],
        mask={"props": []},
        dedup_keys=("event_id",),
        event_time="ts",
    )
    base = shared_dir(spark, "stream", uid())
    q = write_available(out, f"{base}/out", f"{base}/chk")
    q.awaitTermination(120)
    got = spark.read.parquet(f"{base}/out")
    assert got.count() == spark.read.parquet(f"{SF001}/events.parquet").count()
    assert got.filter(F.col("event_type") != F.upper("event_type")).count() == 0


def test_sync_source_all_and_subset(spark):
    from kiln.sources.ods import sync_source

    src = {"id": f"tp{uid()}", "format": "parquet", "path": SF001}
    res = {r.table_name: r.status for r in sync_source(spark, src, ["nation", "partsupp"]).collect()}
    assert res == {"nation": "success", "partsupp": "skipped"}
    every = sync_source(spark, src)
    assert every.filter("status = 'success'").count() == 14


def test_run_model_resolves_catalog(spark):
    sid = f"s{uid()}"
    attach_source(spark, {"id": sid, "format": "parquet", "path": SF001}, ["region"])
    sql = f"SELECT count(*) AS n FROM {{{{ source('{sid}', 'region') }}}}"
    assert run_model(spark, sql).first().n == 5  # found as the attached view
    sync_to_ods(spark, sid, {"nation": spark.read.parquet(f"{SF001}/nation.parquet")})
    sql2 = f"SELECT count(*) AS n FROM {{{{ source('{sid}', 'nation') }}}}"
    assert run_model(spark, sql2).first().n == 25  # found in staging


def test_deliver_all_tables_of_a_database(spark):
    from kiln.sources.ods import write_table

    clean = f"clean{uid()}"
    write_table(spark.range(3), clean, "clean_a")
    write_table(spark.range(4), clean, "clean_b")
    res = {r.prod_table: r.rows for r in D.deliver(spark, clean, "replace", f"prod{uid()}").collect()}
    assert res == {"a": 3, "b": 4}


def test_history_appends_add_up(spark):
    path = shared_dir(spark, "hist", uid())
    for item in ("a", "b"):  # two appends to one run and kind
        D.append_history(spark, path, spark.createDataFrame([(item, 1)], "item string, value long"), 1, "check", "qc", "t", "note")
    got = D.latest_attempts(spark.read.parquet(path)).collect()
    assert sorted((r.item, r.operation, r.target, r.details) for r in got) == [("a", "qc", "t", "note"), ("b", "qc", "t", "note")]


def test_checks_that_cannot_run_and_empty_reports(spark):
    df = spark.createDataFrame([(1, "a")], "id int, `n.m` string")
    checks = [
        Q.Check("ok", "t", "not_null", "id", lambda: Q.check_not_null(df, ["id"], "t")),
        Q.Check("gone", "t", "not_null", "zz", lambda: Q.check_not_null(df, ["zz"], "t")),
        Q.Check("breaks", "t", "custom", "id", lambda: Q.check_custom(df, "breaks", "raise_error('bad row') > 0", "t", "id")),
    ]
    report = Q.qc_report([Q.run_checks(spark, checks)])
    got = {r.check_name: (r.status, r.message) for r in report.collect()}
    assert got["not_null_t_id"][0] == "pass" and got["gone"][0] == "error" and "zz" in got["gone"][1] and got["breaks"][0] == "error"
    t = Q.qc_totals(report).first()
    assert (t.checks, t.passed, t.errors, t.gate_open) == (3, 1, 2, False)
    assert Q.qc_report([]).count() == 0
    assert Q.check_unique(df, ["n.m"], "t").first().failures == 0


def test_gate_names_every_failing_check(spark):
    rows = [(f"c{i}", "t", "custom", "x", 1) for i in range(80)]
    report = Q.qc_report([spark.createDataFrame(rows, Q.CHECK_SCHEMA)])
    with pytest.raises(RuntimeError, match="c79"):
        H.require_gate(report)


def test_explore_goes_on_past_a_damaged_table(spark):
    from kiln.plans.explore import explore

    root = shared_dir(spark, "explore", uid())
    spark.range(4).write.parquet(f"{root}/good.parquet")
    spark.range(4).write.parquet(f"{root}/bad.parquet")
    folder = root.removeprefix("file:") + "/bad.parquet"
    for f in os.listdir(folder):
        if f.startswith("part-"):
            with open(f"{folder}/{f}", "wb") as out:
                out.write(b"damaged")
    report = explore(spark, {"id": "x", "format": "parquet", "path": root})
    assert {r.table_name: r.row_count for r in report.catalog.collect()} == {"bad": -1, "good": 4}
    assert [r.column_name for r in report.columns.collect()] == ["id"]
    assert explore(spark, {"id": "x", "format": "parquet", "path": root}, max_tables=1).summary.first().tables_left_out == 1
    assert explore(spark, {"id": "x", "format": "parquet", "path": root}, tables=[]).columns.count() == 0


def test_history_rerun_replaces_its_run(spark):
    path = shared_dir(spark, "hist", uid())
    for run, v in ((1, 5), (2, 2), (2, 3)):  # run 2 written twice: the second replaces the first
        D.append_history(spark, path, spark.createDataFrame([("chk", v)], "item string, value long"), run, "check")
    rows = D.compare_runs(spark.read.parquet(path)).orderBy("run_id").collect()
    assert [(r.run_id, r.value) for r in rows] == [(1, 5), (2, 3)]


def test_orphans_with_hot_key(spark):
    child = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 50).alias("k"))
    parent = spark.range(50).select(F.col("id").alias("k"))
    r = Q.check_references(child, "k", parent, "k", "c", "p").first()
    assert r.failures == 1000


def boom(df):
    return df.select(F.raise_error(F.lit("source lost")).cast("long").alias("id"))


def test_failed_refresh_and_copy_leave_the_old_rows(spark):
    sid = f"s{uid()}"
    sync_to_ods(spark, sid, {"a": spark.range(4), "b": spark.range(5)})
    reader = spark.table(f"ods_{sid}.b").selectExpr("sum(id) AS s")
    res = {r.table_name: r.status for r in sync_to_ods(spark, sid, {"a": boom(spark.range(3)), "b": spark.range(7)}).collect()}
    assert res == {"a": "failed", "b": "success"}
    assert spark.table(f"ods_{sid}.a").count() == 4 and spark.table(f"ods_{sid}.b").count() == 7
    assert reader.first().s == 10  # a reader of the version before can finish
    path = shared_dir(spark, "copy", uid(), "t")
    bulk_copy(spark.range(6), {"path": path})
    with pytest.raises(Exception):
        bulk_copy(boom(spark.range(3)), {"path": path})
    assert spark.read.parquet(path).count() == 6
    assert bulk_copy(spark.read.parquet(path).where("id < 2"), {"path": path}) == 2  # a table may be copied onto itself
    assert spark.read.parquet(path).count() == 2


def test_refresh_with_other_columns_and_partitions(spark):
    from kiln.sources.ods import write_table

    db = f"w{uid()}"
    write_table(spark.range(3), db, "t")
    write_table(spark.range(4).selectExpr("id", "id * 2 AS twice"), db, "t")
    assert spark.table(f"{db}.t").columns == ["id", "twice"] and spark.table(f"{db}.t").count() == 4
    write_table(spark.table(f"{db}.t").where("id > 1"), db, "t")
    assert spark.table(f"{db}.t").count() == 2
    for n in (5, 6):
        assert write_table(spark.range(n).selectExpr("id", "id % 2 AS part"), db, "p", ["part"]) == n
        assert spark.table(f"{db}.p").where("part = 1").count() == n // 2
    write_table(spark.range(2), db, "t2", mode="append")
    write_table(spark.range(3), db, "t2", mode="append")
    assert spark.table(f"{db}.t2").count() == 5


def versions(spark, db, name):
    from kiln.sources.attach import list_folder

    tables = {t.name for t in spark.catalog.listTables(db) if t.name.startswith(f"{name}__v")}
    return tables | {f for f in list_folder(spark, shared_dir(spark, "warehouse", f"{db}.db")) if f.startswith(f"{name}__v")}


@pytest.mark.parametrize("kind", ["atomic", "replace"])
def test_a_dead_delivery_costs_no_live_version(spark, kind):
    from kiln.sources.ods import ensure_database, write_table
    from kiln.sources.publish import new_attempt

    db, deliver = f"prod{uid()}", {"atomic": D.deliver_atomic, "replace": D.deliver_replace}[kind]
    deliver(spark.range(10), db, "t")
    live = versions(spark, db, "t")
    reader = spark.table(f"{db}.t").selectExpr("sum(id) AS s")
    orphan = new_attempt("t")  # a delivery that dies before it switches
    ensure_database(spark, db)
    if kind == "atomic":
        write_table(spark.range(99), db, orphan, managed=True)
    else:
        spark.range(99).write.parquet(shared_dir(spark, "warehouse", f"{db}.db", orphan))
    deliver(spark.range(5), db, "t", grace=3600)
    assert live < versions(spark, db, "t") and orphan in versions(spark, db, "t")  # it may still be at work
    assert reader.first().s == 45 and spark.table(f"{db}.t").count() == 5
    now = versions(spark, db, "t") - live - {orphan}
    deliver(spark.range(6), db, "t", grace=0)
    left = versions(spark, db, "t")
    assert orphan not in left and not live & left and now < left and len(left) == 2
    assert spark.table(f"{db}.t").count() == 6


def test_a_copy_that_died_between_the_renames_is_restored(spark):
    from kiln.sources import publish

    path = shared_dir(spark, "copy", uid(), "t")
    bulk_copy(spark.range(6), {"path": path})
    publish._rename(spark, path, f"{path}__old")
    with pytest.raises(Exception):
        bulk_copy(boom(spark.range(3)), {"path": path})
    assert spark.read.parquet(path).count() == 6


def derby(schema=None):
    # embedded, in-memory Derby in the driver JVM: no server, no port (local mode only)
    url = f"jdbc:derby:memory:kiln{uid()};create=true"
    out = {"id": "prod", "format": "jdbc", "url": url, "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    return out | ({"schema": schema} if schema else {})


def test_a_failed_jdbc_copy_leaves_the_old_table(spark):
    from kiln.sources.attach import read_source_table

    target = derby()
    rows = lambda: read_source_table(spark, target, "T").count()
    assert bulk_copy(spark.range(6), {**target, "dbtable": "T"}) == 6
    with pytest.raises(Exception):
        bulk_copy(boom(spark.range(3)), {**target, "dbtable": "T"})
    assert rows() == 6
    assert bulk_copy(spark.range(4), {**target, "dbtable": "T"}) == 4 and rows() == 4
    assert list_source_tables(spark, target) == ["APP.T"]  # nothing is left beside it


def test_the_target_decides_the_strategy(spark):
    from kiln.sources.attach import read_source_table

    target = derby("SALES")
    tables = {"clean_orders": spark.range(5), "clean_bad": boom(spark.range(1))}
    for n in (5, 8):
        res = {r.prod_table: r for r in D.deliver(spark, tables | {"clean_orders": spark.range(n)}, target=target).collect()}
        assert (res["orders"].strategy, res["orders"].status, res["orders"].rows) == ("copy", "success", n)
        assert res["bad"].status == "failed"
    assert read_source_table(spark, target, "SALES.ORDERS").count() == 8
    assert D.deliver(spark, {"clean_a": spark.range(1)}, prod_db=f"p{uid()}").first().strategy == "atomic"
    assert D.deliver(spark, {"clean_a": spark.range(1)}, "copy").first().status == "error"
    planned = D.deliver(spark, {"clean_a": spark.range(1)}, target=target, dry_run=True).first()
    assert planned.message == "clean_a -> SALES.a"


def jdbc_parts(spark, target, table, column, n):
    from kiln.sources.attach import read_source_table

    df = read_source_table(spark, target, table, {"partitionColumn": column, "numPartitions": n})
    sizes = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
    return df, sorted(r["count"] for r in sizes)


@pytest.mark.parametrize(
    "key",
    [
        "CASE WHEN id < 3800 THEN id ELSE id * 1000000 END",  # nearly all keys in a thousandth of the range
        "concat(CASE WHEN id % 3 = 0 THEN 'it''s ' ELSE 'z' END, lpad(cast(id AS string), 6, '0'))",
        "date_add(DATE '2001-02-03', cast(id * id / 4000 AS int))",
        "timestamp_seconds(1000000000 + id * id * 7)",
        "cast(pow(1.001, id) AS decimal(20,4))",
    ],
    ids=["numbers", "text", "dates", "times", "decimals"],
)
def test_jdbc_parts_are_of_equal_size(spark, key):
    target = derby()
    rows = spark.range(4000).selectExpr("id", f"CASE WHEN id % 40 <> 7 THEN {key} END AS cut")
    w = rows.write.format("jdbc").options(url=target["url"], driver=target["driver"], dbtable="T")
    if rows.schema["cut"].dataType.simpleString() == "string":  # Spark makes a CLOB of a string for Derby, which compares none, and of a null too
        rows = rows.fillna("nothing")
        w = rows.write.format("jdbc").options(url=target["url"], driver=target["driver"], dbtable="T")
        w = w.option("createTableColumnTypes", "cut VARCHAR(64)")
    w.save()
    df, sizes = jdbc_parts(spark, target, "T", '"cut"', 5)
    assert len(sizes) == 5 and sizes[-1] <= 2 * sizes[0]
    assert sum(sizes) == 4000 and df.select("id").distinct().count() == 4000  # each row once, also those without a key


def test_jdbc_parts_of_few_values(spark):
    target = derby()
    bulk_copy(spark.range(900).selectExpr("id", "CASE WHEN id < 300 THEN 5 ELSE id END AS k"), {**target, "dbtable": "T"})
    df, sizes = jdbc_parts(spark, target, "T", '"k"', 6)
    assert sum(sizes) == 900 and 3 <= len(sizes) <= 6 and sizes[-1] <= 450
    bulk_copy(spark.range(9).selectExpr("id", "cast(null AS int) AS k"), {**target, "dbtable": "N"})
    assert jdbc_parts(spark, target, "N", '"k"', 6)[1] == [9]
    bulk_copy(spark.range(0).selectExpr("id", "id AS k"), {**target, "dbtable": "E"})
    assert jdbc_parts(spark, target, "E", '"k"', 6)[1] == []


def test_history_appends_once_per_key_and_compacts(spark):
    path = shared_dir(spark, "history", uid())
    rows = lambda n: spark.createDataFrame([("a", n), ("b", n + 1)], "item string, value long")
    assert D.append_history(spark, path, rows(1), 1, "check", key="job-1")
    assert not D.append_history(spark, path, rows(1), 1, "check", key="job-1")  # a retry
    assert D.append_history(spark, path, rows(5), 1, "check", key="job-2")
    assert D.append_history(spark, path, rows(7), 2, "check")
    before = sorted(map(tuple, D.compare_runs(spark.read.parquet(path)).collect()))
    assert spark.read.parquet(path).count() == 6 and len(before) == 4
    assert D.compact_history(spark, path) == 6
    after = spark.read.parquet(path)
    assert len(after.inputFiles()) == 2 and sorted(map(tuple, D.compare_runs(after).collect())) == before
    assert not D.append_history(spark, path, rows(1), 1, "check", key="job-2")
