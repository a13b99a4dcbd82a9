"""PII detection and masking on the cases the driver data lacks."""

import pytest
from pyspark.sql import functions as F

from kiln.functions import pii as X
from kiln.operators import pii as I
from kiln.plans.names import name_is_sensitive, pii_types_by_name, prod_name

CASES = [
    ("13812345678", "value", ["china_mobile", "phone"]),
    ("110101199003074578", "value", ["china_idcard", "bank_card"]),  # 18 digits: too long for a phone
    ("6222020200112233", "value", ["bank_card"]),
    ("123456789", "value", ["phone", "passport"]),
    ("E12345678", "value", ["passport"]),
    ("192.168.1.20", "value", ["ipv4"]),
    ("a.b@example.com", "value", ["email"]),
    ("20240101", "value", []),  # year-like, not a phone
    ("999999", "value", []),  # small number: a key
    ("123456789012", "order_no", []),  # key-like column name
    ("张三", "value", ["chinese_name"]),
    ("欧阳娜娜", "value", ["chinese_name"]),
    ("北京市朝阳区建国路88号", "value", ["address"]),
    ("2024-01-05", "value", []),
    ("x", "value", []),
    ("  13812345678 ", "value", ["china_mobile", "phone"]),
    ("hello world", "value", []),
]


@pytest.mark.parametrize("value,col,expected", CASES)
def test_pii_types(spark, value, col, expected):
    got = spark.range(1).select(X.pii_types(F.lit(value), X.name_has_key_hint(col)).alias("t")).first().t
    assert got == expected


def test_null_value_has_no_labels(spark):
    assert spark.range(1).select(X.pii_labels(F.lit(None).cast("string")).alias("t")).first().t == ""


@pytest.mark.parametrize(
    "name,sensitive,types",
    [
        ("group_name", False, []),
        ("username", False, []),
        ("patientName", True, ["chinese_name"]),
        ("hotel", False, ["phone"]),  # a known false hit of the ends-with rule
        ("email_address", True, ["address", "email"]),
        ("gender", False, []),
        ("患者姓名", True, ["chinese_name"]),
        ("dob", False, ["birth_date"]),
    ],
)
def test_name_rules(name, sensitive, types):
    assert name_is_sensitive(name) == sensitive
    assert sorted(pii_types_by_name(name)) == sorted(types)


@pytest.mark.parametrize(
    "value,expected",
    [(None, None), ("", "*"), ("a", "*"), ("ab", "ab"), ("abcdef", "a****f"), ("abcdefg", "ab***fg")],
)
def test_mask_default(spark, value, expected):
    got = spark.range(1).select(X.mask_default(F.lit(value).cast("string")).alias("m")).first().m
    assert got == expected


def test_mask_default_strict_two_chars(spark):
    assert spark.range(1).select(X.mask_default(F.lit("ab"), strict=True).alias("m")).first().m == "a*"


@pytest.mark.parametrize(
    "value,expected",
    [("1990-01-02", "1990-**-**"), ("1990/1/2", "1990/**/**"), ("1990-1/2", "19****/2"), ("19900102", "19****02")],
)
def test_mask_birth_date(spark, value, expected):
    assert spark.range(1).select(X.mask_birth_date(F.lit(value)).alias("m")).first().m == expected


@pytest.mark.parametrize(
    "value,expected",
    [
        ("北京市朝阳区建国路88号", "北京市朝阳区******"),
        ("广东省深圳市", "广东省深圳市"),  # nothing after the last division
        ("某某小屋", "某***"),  # no division, short
        ("某某小区", "某某小区"),  # ends in a division word: nothing to hide
        ("Main Street 5", "Ma***********"),
        ("浙江省杭州市西湖区文三路", "浙江省杭州市西湖区****"),
    ],
)
def test_mask_address(spark, value, expected):
    assert spark.range(1).select(X.mask_address(F.lit(value)).alias("m")).first().m == expected


def test_mask_name_and_dispatch(spark):
    df = spark.createDataFrame([("张三丰", "x1", "13812345678")], "patient_name string, group_name string, phone string")
    out = I.mask_table(df, {"patient_name": ["chinese_name"], "group_name": [], "phone": ["phone"]}).first()
    assert out.patient_name == "张**"
    assert out.group_name == "x1"  # two characters, default mask keeps them
    assert out.phone == "13*******78"


def test_scan_threshold_and_name_wins(spark):
    rows = [("13812345678" if i < 2 else "abc", "x", f"u{i}@a.com") for i in range(10)]
    df = spark.createDataFrame(rows, "contact string, nickname string, mail_addr string")
    scan = {r.column_name: r for r in I.pii_scan(df, 0.3).collect()}
    assert scan["contact"].detected_by == "none" and scan["contact"].pii_ratio == 0.2
    assert scan["mail_addr"].detected_by == "name"
    assert scan["nickname"].detected_by == "name"  # ends with "name"
    low = {r.column_name: r for r in I.pii_scan(df, 0.2).collect()}
    assert low["contact"].pii_types == "china_mobile,phone"


def test_tokens_in_whole_text(spark):
    df = spark.createDataFrame([(1, "call 13812345678 or mail a@b.cn, ip 10.0.0.1 " + "word " * 5000)], "id long, text string")
    got = {(r.label, r.tokens) for r in I.pii_tokens(df, "text", ["id"]).collect()}
    assert ("china_mobile", 1) in got and ("ipv4", 1) in got


def test_prod_name():
    assert prod_name("clean_patients") == "patients" and prod_name("CLEAN_x") == "x" and prod_name("dim") == "dim"


@pytest.mark.parametrize(
    "column,types,kind",
    [
        ("patient_name", [], "name"), ("name", [], "name"), ("user_name", [], "default"), ("user_name", ["chinese_name"], "name"),
        ("home_address", [], "address"), ("x", ["address"], "address"), ("dob", [], "birth_date"), ("amount", [], "default"),
        ("Name_First", [], "name"), ("患者姓名", [], "name"), ("group_name", ["birth_date"], "birth_date"),
    ],
)
def test_mask_rules_same_in_both_forms(spark, column, types, kind):
    from kiln.functions.pii import mask_kind, mask_kind_expr

    assert mask_kind(types, column) == kind
    assert spark.range(1).select(mask_kind_expr(F.lit(",".join(types)), F.lit(column)).alias("k")).first().k == kind


def test_compound_surnames(spark):
    got = [r[0] for r in spark.createDataFrame([("太史慈",), ("独孤信",), ("欧阳修",)], "v string").select(X.pii_labels("v")).collect()]
    assert got == ["chinese_name"] * 3


def test_strict_masks_reach_tables_and_profiles(spark):
    df = spark.createDataFrame([("ab", "李四"), ("abcdef", "某某")], "code string, home_address string")
    rows = I.mask_table(df, {"code": [], "home_address": []}, strict=True).collect()
    assert rows[0] == ("a*", "李*")
    prof = spark.createDataFrame([("code", "ab", "cd")], "column_name string, min_value string, max_value string")
    assert I.mask_profile(prof, {"code": []}, strict=True).first()[1:] == ("a*", "c*")


def test_scan_of_a_column_with_a_dot(spark):
    df = spark.createDataFrame([("a@b.cn",)], "`a.b` string")
    assert I.pii_scan(df).first().pii_types == "email"


def test_mask_profile_hides_values(spark):
    from kiln.operators.profile import profile_table

    df = spark.createDataFrame([("13812345678", "x"), ("13900000000", "y")], "phone string, note string")
    prof = I.mask_profile(profile_table(df, "t", k=2), {"phone": ["phone"]})
    rows = {r.column_name: r for r in prof.collect()}
    assert rows["phone"].min_value == "13*******78"
    assert all("*" in v for v in rows["phone"].sample_values)
    assert all("*" in s.value for s in rows["phone"].top_values)
    assert rows["note"].min_value == "x"


def test_candidate_tokens_equal_split_and_filter(spark):
    from pyspark.sql import functions as F

    texts = [
        (1, " 13812345678\tword x@y.com\n\n10.0.0.1"),
        (2, "a1b2  13900001111  张三 end\f20240101 "),
        (3, "no candidates here at all"),
        (4, ""),
        (5, "@@ 1 99999999999999999 a@b.c\r\nIP:10.1.1.1"),
    ]
    df = spark.createDataFrame(texts, "id long, text string")
    got = {(r.id, r.label, r.tokens) for r in I.pii_tokens(df, "text", ["id"]).collect()}
    # the plain form: every whitespace token, filtered, labelled
    toks = df.select("id", F.explode(F.split("text", "[ \\t\\n\\r\\f]+")).alias("t")).filter(F.col("t").rlike("[0-9@一-鿿]"))
    lab = toks.select("id", F.explode(F.split(X.pii_labels(F.col("t")), ",")).alias("label")).filter("label <> ''")
    want = {(r.id, r.label, r["count"]) for r in lab.groupBy("id", "label").count().collect()}
    assert got == want and got


def test_scan_of_counted_values_labels_each_distinct_value_once(spark):
    """A scan of a table's value counts gives what a scan of its rows gives."""
    from kiln.operators.profile import value_counts

    rows = [("13800138000", "a@b.com", i % 3, None) for i in range(30)] + [("x", None, 1, None), (None, "plain", 2, None), (" 13900139000 ", "", None, None)] * 4
    df = spark.createDataFrame(rows, "p string, contact string, k int, none string")
    assert I.pii_scan(df, counts=value_counts(df)).collect() == I.pii_scan(df).collect()
    assert {r.column_name: (r.samples, r.detected_by) for r in I.pii_scan(df, counts=value_counts(df)).collect()}["p"] == (38, "value")
    empty = df.limit(0)
    assert I.pii_scan(empty, counts=value_counts(empty)).collect() == I.pii_scan(empty).collect()


def test_explore_groups_the_values_of_a_table_once(spark, tmp_path):
    from kiln.plans.explore import explore

    spark.createDataFrame([(i, f"u{i}@example.com") for i in range(50)], "k int, mail string").write.parquet(f"{tmp_path}/t.parquet")
    found = explore(spark, {"id": "s", "format": "parquet", "path": str(tmp_path)}).columns
    assert {r.column_name: r.detected_by for r in found.collect()}["mail"] in ("name", "value")
    text = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert sum("Exchange hashpartitioning(column_name" in line and ", value#" in line and "ReusedExchange" not in line for line in text.splitlines()) == 1
