"""Profiling on hand-made rows: the reference's patients fixture, NULLs, empty tables, ties."""

from pyspark.sql import functions as F

from kiln.operators import profile as P


def patients(spark):
    return spark.createDataFrame(
        [(1, "Alice", 30, "F", "2024-01-01"), (2, "Bob", None, "M", "2024-01-02"), (3, "Carol", 45, "F", "2024-01-03")],
        "id int, name string, age int, gender string, admission_date string",
    )


def test_patients_stats(spark):
    rows = {r.column_name: r for r in P.column_stats(patients(spark), "patients").collect()}
    assert rows["id"].row_count == 3
    assert rows["age"].null_count == 1
    assert rows["age"].null_rate == 0.3333
    assert rows["name"].is_unique_candidate
    assert not rows["age"].is_unique_candidate  # a NULL makes a column no candidate
    assert not rows["gender"].is_unique_candidate
    assert (rows["age"].min_value, rows["age"].max_value) == ("30", "45")
    assert rows["gender"].unique_count == 2


def test_typed_min_max_not_text_order(spark):
    df = spark.createDataFrame([(9,), (10,), (100,)], "n int")
    r = P.column_stats(df).first()
    assert (r.min_value, r.max_value) == ("9", "100")


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    rows = P.column_stats(df).collect()
    assert all(r.row_count == 0 and r.null_rate == 0.0 and not r.is_unique_candidate for r in rows)
    assert P.top_values(df).count() == 0


def test_all_null_column(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, b string")
    r = [x for x in P.column_stats(df).collect() if x.column_name == "b"][0]
    assert (r.null_count, r.null_rate, r.unique_count, r.min_value) == (2, 1.0, 0, None)
    assert P.sample_values(df, 5, columns=["b"]).count() == 0


def test_null_is_a_top_value_and_ties_break_on_value(spark):
    rows = [(None,)] * 4 + [("e",), ("d",), ("c",), ("b",), ("a",)] * 2 + [("z",)]
    df = spark.createDataFrame(rows, "v string")
    top = [(r.rank, r.value, r["count"]) for r in P.top_values(df, 5).orderBy("rank").collect()]
    assert top == [(1, None, 4), (2, "a", 2), (3, "b", 2), (4, "c", 2), (5, "d", 2)]
    freq = P.top_values(df, 1).first().frequency
    assert freq == round(4 / 15, 4)


def test_samples_distinct_sorted(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("c",)], "v string")
    assert [r.value for r in P.sample_values(df, 2).orderBy("rank").collect()] == ["a", "b"]


def test_profile_table_arrays_bounded(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id"))
    rows = {r.column_name: r for r in P.profile_table(df, "t", k=3).collect()}
    assert len(rows["k"].top_values) == 3 and len(rows["id"].sample_values) == 3
    assert rows["id"].unique_count == 1000 and rows["id"].is_unique_candidate


def test_approx_mode_close(spark):
    df = spark.range(5000).select((F.col("id") % 1000).alias("k"))
    r = P.column_stats(df, approx=True).first()
    assert abs(r.unique_count - 1000) < 60


def test_map_and_array_columns_counts_only(spark):
    df = spark.createDataFrame([([1.0, 2.0], {"a": 1})], "v array<double>, m map<string,int>")
    rows = P.column_stats(df).collect()
    assert all(r.unique_count is None and r.row_count == 1 for r in rows)


def test_catalog_and_summary(spark):
    cat = P.profile_catalog({"a": spark.range(3), "b": spark.range(5).select("id", F.lit(1).alias("x"))})
    s = P.catalog_summary(cat).first()
    assert (s.total_tables, s.total_rows, s.total_columns) == (2, 8, 3)


def test_key_candidates_composite(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 1), (3, None)], "o int, l int")
    rows = {r.key_columns: r for r in P.key_candidates(df, [["o", "l"]]).collect()}
    assert not rows["o,l"].is_key and rows["o,l"].surplus_rows == 1 and rows["o,l"].null_rows == 1
    assert not rows["o"].is_key


def test_hot_value_is_preaggregated(spark):
    # a third of the rows share one value: the plan aggregates partially before the shuffle
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    plan = P.top_values(df, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert P.top_values(df, 1).first()["count"] == 1000


def test_size_shuffle(spark):
    from kiln.session import size_shuffle

    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert size_shuffle(spark, 100 * 1024**4) == 409600
        assert size_shuffle(spark, 1) == 2 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_plan_does_not_depend_on_input_size(spark, tmp_path):
    import re

    def shape(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return re.findall(r"(Exchange \w+|\w+Join|HashAggregate|SortAggregate|Expand|Window\w*)", plan)

    small, large = str(tmp_path / "small"), str(tmp_path / "large")
    cols = [F.col("id"), (F.col("id") % 10).cast("string").alias("s")]
    spark.range(10).select(*cols).coalesce(1).write.parquet(small)
    spark.range(200_000).select(*cols).repartition(12).write.parquet(large)
    assert shape(P.column_stats(spark.read.parquet(small))) == shape(P.column_stats(spark.read.parquet(large)))


def test_profile_has_one_value_exchange_and_no_sort_of_values(spark):
    from tests.conftest import SF001

    df = spark.read.parquet(f"{SF001}/part.parquet")
    stats = P.column_stats(df)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate(key=[column_name" not in stats  # the wide pass has no key, so nothing to sort
    full = P.profile_table(df, "part")
    full.collect()  # reuse is decided when the plan runs
    text = full._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    by_value = [line for line in text.splitlines() if "Exchange hashpartitioning(column_name" in line and ", value#" in line]
    assert "SortAggregate(key=[column_name" not in text
    assert len([line for line in by_value if "ReusedExchange" not in line]) == 1


def test_unique_flag_is_unknown_near_the_row_count(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 10).alias("few"))
    got = {r.column_name: r.is_unique_candidate for r in P.column_stats(df, approx=True).collect()}
    assert got == {"id": None, "few": False}  # the sketch cannot tell; confirm exactly
    assert P.column_stats(df, columns=["id"]).first().is_unique_candidate


def test_odd_column_names_and_types(spark):
    df = spark.sql("SELECT 1 AS `a.b`, 'x' AS `c d`, parse_json('{\"k\": 1}') AS v")
    got = {r.column_name: (r.unique_count, r.row_count) for r in P.column_stats(df).collect()}
    assert got == {"a.b": (1, 1), "c d": (1, 1), "v": (None, 1)}


def test_unreadable_table_is_minus_one(spark, tmp_path):
    path = tmp_path / "t.parquet"
    spark.range(5).write.parquet(str(path))
    bad = spark.read.parquet(str(path))
    for f in path.glob("part-*"):
        f.write_bytes(b"damaged")
    cat = P.profile_catalog({"good": spark.range(3), "bad": bad, "absent": None})
    assert {r.table_name: r.row_count for r in cat.collect()} == {"good": 3, "bad": -1, "absent": -1}
    s = P.catalog_summary(cat, left_out=2).first()
    assert (s.total_tables, s.total_rows, s.tables_left_out) == (3, 3, 2)
    assert P.profile_catalog({}).count() == 0


def test_master_only_when_passed(monkeypatch):
    from pyspark.sql import SparkSession

    from kiln import session

    seen = []
    monkeypatch.setattr(SparkSession.builder, "master", lambda m: seen.append(m) or SparkSession.builder)
    session.get_spark()
    assert seen == []


def test_null_count_alone(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (None, None)], "a int, b string")
    got = {r.column_name: (r.row_count, r.null_count, r.null_rate) for r in P.null_count(df).collect()}
    assert got == {"a": (3, 1, 0.3333), "b": (3, 2, 0.6667)}
    empty = {r.column_name: (r.row_count, r.null_count, r.null_rate) for r in P.null_count(df.limit(0)).collect()}
    assert empty == {"a": (0, 0, 0.0), "b": (0, 0, 0.0)}


def test_unique_count_and_min_max_alone(spark):
    from datetime import date

    df = spark.createDataFrame([(9, "b", date(2024, 1, 5)), (10, "a", None), (10, None, date(2023, 12, 31))], "k int, s string, d date")
    u = {r.column_name: (r.row_count, r.unique_count, r.is_unique_candidate) for r in P.unique_count(df).collect()}
    assert u == {"k": (3, 2, False), "s": (3, 2, False), "d": (3, 2, False)}
    m = {r.column_name: (r.min_value, r.max_value) for r in P.min_max(df).collect()}
    assert m == {"k": ("9", "10"), "s": ("a", "b"), "d": ("2023-12-31", "2024-01-05")}  # typed order: 9 < 10


def test_cluster_sessions_keep_their_shuffle_partitions():
    from kiln.session import shuffle_partitions_for

    assert shuffle_partitions_for("local[8]", None, 8) == 16
    assert shuffle_partitions_for("yarn", None, 8) is None  # cluster: its own setting or size_shuffle
    assert shuffle_partitions_for("spark://host:7077", 4000, 8) == 4000
    assert shuffle_partitions_for(None, None, 8) is None


def test_frequent_values_equal_the_full_count(spark):
    from kiln.operators import frequent as FQ

    rows = spark.range(30_000).selectExpr(
        "CASE WHEN id % 10 < 4 THEN 'hot' WHEN id % 10 = 5 THEN NULL ELSE concat('v', id % 7) END AS a",  # ties, a null group
        "id % 3 AS b", "id AS unique_id", "CAST(NULL AS int) AS nothing", "id % 20000 AS nearly", "CAST(id % 2 AS double) / 0.3 AS f",
        "CASE WHEN id < 9000 THEN -1 ELSE id % 15000 END AS heavy", "CASE WHEN id % 4 = 0 THEN 0 WHEN id % 4 = 1 THEN 1 WHEN id % 4 = 2 THEN 2 WHEN id % 8 = 3 THEN 3 ELSE 4 END AS few",
    )
    for k in (1, 3, 5):
        got = {tuple(r) for r in FQ.frequent_values(rows, k, "t", track=512).collect()}
        assert got == {tuple(r) for r in P.top_values(rows, k, "t").collect()}
    plans = {p.column: p.proven for p in FQ.plan_frequent(rows, 1, track=512)}
    assert plans["heavy"] and plans["a"] and plans["b"] and plans["nothing"] and not plans["unique_id"]
    assert {tuple(r) for r in FQ.frequent_values(rows.limit(0), 3, "t").collect()} == {tuple(r) for r in P.top_values(rows.limit(0), 3, "t").collect()}


def test_proven_columns_shuffle_no_values(spark):
    from kiln.operators import frequent as FQ

    rows = spark.range(5000).selectExpr("id % 5 AS a", "id AS b")
    out = FQ.frequent_values(rows, 3, "t", ["a"])
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 3


def test_distinct_sample_is_that_of_the_hashes(spark):
    import hashlib

    from kiln.operators import frequent as FQ

    rows = spark.range(20_000).selectExpr("id AS u", "CASE WHEN id % 3 = 0 THEN NULL ELSE 'x' END AS one", "id % 300 AS s", "CAST(NULL AS string) AS none")
    got = {}
    for r in FQ.distinct_sample(rows, 7).collect():
        got.setdefault(r.column_name, []).append(r.value)
    md5 = lambda v: hashlib.md5(v.encode()).hexdigest()
    assert got == {"u": sorted(map(str, range(20_000)), key=md5)[:7], "one": ["x"], "s": sorted(map(str, range(300)), key=md5)[:7]}
    again = FQ.distinct_sample(rows.unionByName(rows.where("u < 50")).orderBy(F.desc("u")), 7)
    assert {(r.column_name, r.value) for r in again.collect()} == {(c, v) for c, vs in got.items() for v in vs}
    assert FQ.distinct_sample(rows.limit(0), 7).count() == 0


def test_kept_profiles_read_only_new_files(spark):
    import uuid

    from kiln.operators import profile_state as PS
    from kiln.session import shared_dir
    from kiln.sources.attach import remove_folder

    root, state = shared_dir(spark, "parts", uuid.uuid4().hex), shared_dir(spark, "state", uuid.uuid4().hex)
    rows = spark.range(3000).selectExpr(
        "id", "CASE WHEN id % 5 = 0 THEN NULL ELSE id % 37 END AS m", "date_add(DATE '2020-01-01', cast(id % 400 AS int)) AS day",
        "CAST(id AS decimal(12,2)) / 7 AS v", "CAST(NULL AS string) AS nothing",
    )
    files = [f"{root}/day={k}.parquet" for k in range(3)]
    for k, f in enumerate(files):
        rows.where(f"id % 3 = {k}").write.parquet(f)
    read = PS.read_files(spark)
    assert PS.update_states(spark, state, files[:2], read) == files[:2]
    for f in files[:2]:
        remove_folder(spark, f)  # an old file that were opened again would be missed
    assert PS.update_states(spark, state, files, read) == files[2:]
    assert PS.update_states(spark, state, files, read) == []
    states = spark.read.parquet(state)
    for twice in (states, states.unionByName(states)):  # stored by two updates at once
        got = {r.column_name: r for r in PS.merged_profile(twice, rows).collect()}
        want = {r.column_name: r for r in P.column_stats(rows).collect()}
        assert got.keys() == want.keys()
        for c, w in want.items():
            g = got[c]
            assert (g.row_count, g.null_count, g.null_rate, g.min_value, g.max_value) == (w.row_count, w.null_count, w.null_rate, w.min_value, w.max_value)
            assert abs(g.unique_count - w.unique_count) <= 3 * PS.SKETCH_ERROR * w.unique_count
            assert g.is_unique_candidate in (None, w.is_unique_candidate)
        assert got["m"].is_unique_candidate is False and got["id"].is_unique_candidate is None


def test_a_failed_update_adds_no_state(spark):
    import uuid

    from kiln.operators import profile_state as PS
    from kiln.session import shared_dir

    state = shared_dir(spark, "state", uuid.uuid4().hex)
    bad = spark.range(10).selectExpr("id", "CASE WHEN id < 5 THEN 'a' ELSE raise_error('lost') END AS part")
    try:
        PS.update_states(spark, state, ["a", "b"], lambda _: bad)
    except Exception:
        pass
    assert PS.known_parts(spark, state) == set()
    good = spark.range(10).selectExpr("id", "CASE WHEN id < 5 THEN 'a' ELSE 'b' END AS part")
    assert PS.update_states(spark, state, ["a", "b"], lambda _: good) == ["a", "b"]
    assert PS.merged_profile(spark.read.parquet(state), good).first().row_count == 10


def test_nulls_stay_null_beside_a_not_null_column(spark):
    from kiln.operators.pii import pii_values

    rows = spark.range(30).selectExpr("id", "CAST(NULL AS string) AS nothing", "id % 2 = 0 AS flag", "IF(id < 3, id, NULL) AS few")
    assert not rows.schema["id"].nullable
    counts = {(r.column_name, r.value): r["count"] for r in P.value_counts(rows).collect()}
    assert counts["nothing", None] == 30 and counts["few", None] == 27
    assert {r.column_name: r.unique_count for r in P.unique_count(rows).collect()} == {"id": 30, "nothing": 0, "flag": 2, "few": 3}
    assert pii_values(rows, ["id", "nothing", "few"]).where("value IS NULL").count() == 57


def test_rows_of_one_large_partition_are_spread_before_they_are_grouped(spark, monkeypatch):
    """The map of distinct values of one task is bounded, however many rows a file holds."""
    monkeypatch.setattr(P, "TASK_VALUES", 1000)
    df = spark.range(0, 2000, 1, 1).select("id", (F.col("id") % 7).cast("string").alias("s"))
    assert P.spread_rows(df).rdd.getNumPartitions() == 4
    assert P.spread_rows(df.repartition(8)).rdd.getNumPartitions() == 8
    assert max(P.spread_rows(df).rdd.glom().map(len).collect()) <= 510
    text = P.typed_counts(df)[0]._jdf.queryExecution().toString()
    assert "RoundRobinPartitioning(4)" in text
    assert {r.column_name: r.unique_count for r in P.column_stats(df).collect()} == {"id": 2000, "s": 7}
    assert P.spread_rows(df.limit(0)).count() == 0
