"""Clean rules, map-layer operators, standard and coverage on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from kiln.operators import mapping as M
from kiln.operators.cleaning import apply_clean_rules, deduplicate
from kiln.operators.standard import conform, coverage_audit, readiness
from kiln.plans.spec import CleanRule, Dedup, Field, Mapping, Standard, parse_field_type, spark_type


def test_rules_apply_in_list_order(spark):
    df = spark.createDataFrame([("  bob ",), (None,)], "patient_name string")
    out = apply_clean_rules(df, [CleanRule("patient_name", ("trim_whitespace", "coalesce_null"), default="未知")])
    assert [r.patient_name for r in out.collect()] == ["bob", "未知"]


def test_trim_upper_lower_idempotent(spark):
    df = spark.createDataFrame([("  MiXed  ",)], "s string")
    rule = [CleanRule("s", ("trim_whitespace", "lowercase"))]
    once = apply_clean_rules(df, rule)
    assert once.collect() == apply_clean_rules(once, rule).collect()


def test_cast_raises_or_nulls(spark):
    df = spark.createDataFrame([("x1",), (" 12 ",)], "v string")
    with pytest.raises(Exception):
        apply_clean_rules(df, [CleanRule("v", ("cast_type",), "INTEGER")]).collect()
    out = apply_clean_rules(df, [CleanRule("v", ("cast_type",), "INTEGER", on_error="null")])
    assert [r.v for r in out.collect()] == [None, 12]


def test_standardize_date_formats(spark):
    df = spark.createDataFrame([("2024/01/05",), ("05-01-2024",), ("2024-01-05",), ("junk",)], "d string")
    out = [r.d for r in apply_clean_rules(df, [CleanRule("d", ("standardize_date",), on_error="null")]).collect()]
    assert [str(x) if x else None for x in out] == ["2024-01-05", "2024-01-05", "2024-01-05", None]


def test_dedup_latest_per_key_with_hot_key(spark):
    # one key holds a third of all rows; the partial group limit keeps one row per task
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"), F.col("id").alias("ts")
    )
    out = deduplicate(df, ["k"], ["ts"], "last")
    assert out.count() == 2001
    assert out.filter("k = 0").first().ts == 2997
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_unknown_rule_rejected(spark):
    df = spark.createDataFrame([("a",)], "s string")
    with pytest.raises(ValueError):
        apply_clean_rules(df, [CleanRule("s", ("reverse",))])


def test_dedup_rule_in_spec(spark):
    df = spark.createDataFrame([(1, 1), (1, 2)], "k int, v int")
    out = apply_clean_rules(df, [], Dedup(("k",), ("v",), "first"))
    assert out.collect()[0].v == 1


@pytest.mark.parametrize(
    "text,expected",
    [
        ("INTEGER NOT NULL", ("INTEGER", False)),
        ("VARCHAR(40) NOT NULL", ("VARCHAR(40)", False)),
        ("TIMESTAMP", ("TIMESTAMP", True)),
        ("  SMALLINT  ", ("SMALLINT", True)),
        ("varchar(10) Not Null", ("varchar(10)", False)),
    ],
)
def test_parse_field_type(text, expected):
    assert parse_field_type(text) == expected


def test_spark_types():
    assert spark_type("VARCHAR(40) NOT NULL") == "string"
    assert spark_type("NUMERIC(10,2)") == "decimal(10,2)"
    assert spark_type("TIMESTAMP") == "timestamp_ntz"
    assert spark_type("SMALLINT") == "smallint"
    assert [spark_type(t) for t in ("INT4", "INT8", "FLOAT8", "float8")] == ["int", "bigint", "double", "double"]
    assert spark_type("NUMERIC") == "decimal(38,18)" and spark_type("decimal(12)") == "decimal(12,0)"
    assert spark_type("TIMESTAMP WITH TIME ZONE") == spark_type("timestamp(3) with time zone") == "timestamp"
    assert spark_type("BYTEA") == "binary" and spark_type("array<int>") == "array<int>" and spark_type("text") == "string"
    with pytest.raises(ValueError):
        spark_type("GEOMETRY")


def test_max_length():
    from kiln.plans.spec import max_length

    assert (max_length("VARCHAR(40) NOT NULL"), max_length("char(3)"), max_length("TEXT"), max_length("NUMERIC(4,2)")) == (40, 3, None, None)


def test_dates_from_timestamps_and_bad_text(spark):
    from kiln.operators.cleaning import unparsed_dates

    df = spark.sql("SELECT timestamp'2024-01-05 10:00:00' AS t, '2024-01-05 10:00:00' AS s, 'soon' AS bad, ' ' AS blank")
    good = apply_clean_rules(df, [CleanRule(c, ("standardize_date",)) for c in ("t", "s", "blank")]).first()
    assert str(good.t) == str(good.s) == "2024-01-05" and good.blank is None
    assert apply_clean_rules(df, [CleanRule("bad", ("standardize_date",), on_error="null")]).first().bad is None
    with pytest.raises(Exception, match="not a date: soon"):
        apply_clean_rules(df, [CleanRule("bad", ("standardize_date",))]).collect()
    assert unparsed_dates(df, ["t", "s", "bad", "blank"]).first().asDict() == {"t": 0, "s": 0, "bad": 1, "blank": 0}


def test_dedup_rule_needs_keys(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(ValueError, match="deduplicate"):
        apply_clean_rules(df, [CleanRule("k", ("deduplicate",))])


def test_gap_fill_merge_case_and_side_table(spark):
    df = spark.createDataFrame([("x", "y", 7, 1)], "a string, b string, Age int, k int")
    side = spark.createDataFrame([(1, "one")], "id int, word string")
    gaps = [
        Mapping("m", "merge", sources=("a", "b"), merge_how="concat", separator="-"),
        Mapping("age2", "direct", "t", "age"),
        Mapping("w", "direct", "s", "word"),
        Mapping("none", "direct", "s", "absent"),
    ]
    others = {"s": M.SideTable(side, "k", "id")}
    r = M.gap_fill(df, gaps, others=others).first()
    assert (r.m, r.age2, r.w, r.none) == ("x-y", 7, "one", None)
    assert M.missing_gaps(df, gaps, others) == ["none"]


@pytest.mark.parametrize(
    "value,expected", [("MRN-007", 7), ("MRN-100", 100), ("no digits", None), ("42", 42), (None, None)]
)
def test_normalise_key(spark, value, expected):
    assert spark.range(1).select(M.normalise_key(F.lit(value).cast("string")).alias("k")).first().k == expected


def test_preaggregate_keeps_row_count(spark):
    one = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    many = spark.createDataFrame([(1, 5.0), (1, 6.0), (2, 1.0), (9, 1.0)], "id int, amount double")
    direct = one.join(many, "id")
    pre = M.preaggregate_join(one, many, "id", "id", {"n": F.count(F.lit(1)), "total": F.sum("amount")}, zero_fill=("n",))
    assert pre.count() == 3
    got = {r.id: (r.n, r.total) for r in pre.collect()}
    assert got == {1: (2, 11.0), 2: (1, 1.0), 3: (0, None)}
    audit = M.fanout_audit(one, direct, "id").first()
    assert (audit.base_rows, audit.joined_rows, audit.repeated_keys, audit.inflated) == (3, 3, 1, False)
    audit2 = M.fanout_audit(many, one.join(many, "id"), "id").first()
    assert audit2.max_rows_per_key == 2


def test_merge_and_missing_mappings(spark):
    df = spark.createDataFrame([(None, "b", 1)], "a string, b string, n int")
    std = Standard("t", (Field("x", "TEXT"), Field("y", "TEXT"), Field("z", "INTEGER")))
    out = M.build_map(
        df,
        [Mapping("x", "merge", sources=("a", "b")), Mapping("y", "merge", sources=("b", "n"), merge_how="concat"), Mapping("z", "missing")],
        std,
    )
    r = out.first()
    assert (r.x, r.y, r.z) == ("b", "b 1", None)
    assert dict(out.dtypes)["z"] == "int"


def test_gap_fill_and_conform(spark):
    df = spark.createDataFrame([(1, "n", "30")], "patient_id int, name string, age string")
    std = Standard("p", (Field("patient_id", "INTEGER", False), Field("name", "TEXT"), Field("age", "INTEGER"), Field("address", "TEXT")))
    out = conform(M.gap_fill(df, [Mapping("age", "transform", expr="CAST(age AS INT)"), Mapping("address", "direct", source_field="addr")], std), std)
    assert out.columns == ["patient_id", "name", "age", "address"]
    assert dict(out.dtypes)["age"] == "int" and out.first().address is None


def test_bucket_and_dates(spark):
    df = spark.createDataFrame([(5,), (25,), (70,), (None,)], "age int")
    got = [r.g for r in df.select(M.bucket("age", [18, 65], ["child", "adult", "senior"]).alias("g")).collect()]
    assert got == ["child", "adult", "senior", None]
    r = spark.range(1).select(M.age_years(F.lit("1990-03-15").cast("date"), F.lit("2024-03-14").cast("date")).alias("a")).first()
    assert r.a == 33


def test_unprotected_not_null(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, name string")
    std = Standard("t", (Field("id", "INTEGER", False), Field("name", "TEXT", False)))
    assert [(r.field, r.null_rows) for r in M.unprotected_not_null(df, std).collect()] == [("name", 1)]


@pytest.mark.parametrize(
    "cols,missing",
    [
        (["patient_id", "name", "age", "gender"], []),
        (["patient_id", "name"], ["age", "gender"]),
        (["other"], ["patient_id", "name", "age", "gender"]),
    ],
)
def test_coverage(spark, cols, missing):
    std = Standard("p", tuple(Field(n, "TEXT") for n in ["patient_id", "name", "age", "gender"]))
    df = spark.createDataFrame([tuple("v" for _ in cols)], ", ".join(f"{c} string" for c in cols))
    cov = coverage_audit(df, std).orderBy("position").collect()
    assert [r.field_name for r in cov if not r.present] == missing


def test_coverage_empty_model(spark):
    std = Standard("p", (Field("a", "TEXT"),))
    cov = coverage_audit(spark.createDataFrame([], "a string"), std).first()
    assert cov.present and cov.fill_rate == 0.0


def test_readiness_levels(spark):
    std = Standard("p", (Field("a", "TEXT"), Field("b", "TEXT")))
    full = spark.createDataFrame([("x", "y")], "a string, b string")
    assert readiness(coverage_audit(full, std)).first().recommendation == "auto"
    half = spark.createDataFrame([("x", None), ("x", "y")], "a string, b string")
    r = readiness(coverage_audit(half, std)).first()
    assert (r.confidence, r.recommendation) == (0.75, "suggest")
    none = spark.createDataFrame([("x",)], "z string")
    assert readiness(coverage_audit(none, std)).first().recommendation == "manual"


def test_gap_fill_finds_the_tables_of_an_expression(spark):
    base = spark.createDataFrame([(1, 10, 2.0), (2, 20, 3.0), (3, 99, 4.0)], "id int, k int, v double")
    side = spark.createDataFrame([(10, 5.0, "a"), (20, 7.0, "b"), (None, 0.0, "c"), (None, 1.0, "d")], "key int, w double, v string")
    other = spark.createDataFrame([(10, 1.5, 100)], "key int, w double, u int")
    others = {"side": M.SideTable(side, "k", "key"), "other": M.SideTable(other, "k", "key")}
    gaps = [
        Mapping("total", "transform", "side", expr="v + W"),  # v is the base's own, w the gap table's
        Mapping("text", "transform", "side", expr="concat(side.v, '/', id)"),
        Mapping("both", "merge", "other", sources=("other.w", "u"), merge_how="sum"),
        Mapping("u", "transform", expr="coalesce(u, -1)"),  # a target with the name of a field
    ]
    out = M.gap_fill(base, gaps, others=others)
    assert out.columns == ["id", "k", "v", "total", "text", "both", "u"]
    assert sorted(map(tuple, out.collect())) == [
        (1, 10, 2.0, 7.0, "a/1", 101.5, 100), (2, 20, 3.0, 10.0, "b/2", None, -1), (3, 99, 4.0, None, None, None, -1)]
    with pytest.raises(ValueError, match="w is a field of"):
        M.gap_fill(base, [Mapping("x", "transform", expr="w + 1")], others=others)


def test_gap_fill_raises_where_a_side_key_repeats(spark):
    base = spark.createDataFrame([(1, 10)], "id int, k int")
    side = spark.createDataFrame([(10, "a"), (10, "b")], "key int, w string")
    out = M.gap_fill(base, [Mapping("w", "direct", "side")], others={"side": M.SideTable(side, "k", "key")})
    with pytest.raises(Exception, match="key key of side repeats: 10"):
        out.collect()


def test_fanout_forecast_makes_no_join_of_rows(spark):
    base = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,), (None,)], "k int")
    side = spark.createDataFrame([(1,), (1,), (1,), (3,), (None,)], "j int")
    assert tuple(M.fanout_forecast(base, side, "k", "j").first()) == (6, 7, 1, 6, True)
    assert tuple(M.fanout_forecast(base, side, "k", "j", "left").first()) == (6, 10, 2, 6, True)
    assert base.join(side, F.col("k") == F.col("j"), "left").count() == 10
    assert tuple(M.fanout_forecast(base.limit(0), side, "k", "j").first()) == (0, 0, 0, 0, False)
    assert [tuple(r) for r in M.fanout_keys(base, side, "k", "j").collect()] == [(1, 2, 3, 6)]
    plan = M.fanout_forecast(base, side, "k", "j")._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join") :]
    assert below.count("Aggregate") == 2  # both sides are counted before they meet
