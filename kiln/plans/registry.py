"""Registered queries: name -> (Spark build over the given tables, DuckDB oracle SQL).

Every query reads whole tables from ``sf_dir``; none caps, filters by id or
samples its input to stay cheap. Oracle SQL is ``None`` where SQL cannot say
the same thing (the driver then checks rows only).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.operators import profile as P
from kiln.plans.customer360 import customer_360
from kiln.plans.sqltext import profile_sql, ratio4_sql
from kiln.sources.tables import read_table


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None):
    def wrap(fn):
        REGISTRY[name] = Query(fn, sql)
        return fn

    return wrap


def T(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def decimal_doubles(df: DataFrame) -> DataFrame:
    """Doubles as decimal(18,2): text of a double differs between engines (1.0E7 vs 10000000.0)."""
    return df.select(
        *[F.col(f.name).cast("decimal(18,2)").alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema.fields]
    )


# --------------------------------------------------------------------- flagship

CUSTOMER_360_SQL = """
SELECT CAST(c.c_custkey AS BIGINT) AS customer_id,
       upper(trim(c.c_name)) AS customer_name,
       n.n_name AS nation_name,
       r.r_name AS region_name,
       coalesce(lower(trim(c.c_mktsegment)), 'unknown') AS market_segment,
       CAST(c.c_acctbal AS DECIMAL(15,2)) AS account_balance,
       CAST(coalesce(o.order_count, 0) AS BIGINT) AS order_count,
       CAST(coalesce(o.total_spend, 0) AS DECIMAL(18,2)) AS total_spend,
       CAST(o.last_order_ts AS DATE) AS last_order_date,
       CAST(NULL AS VARCHAR) AS email
FROM customer c
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (SELECT o_custkey, count(*) AS order_count,
                  sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total_spend,
                  max(o_orderdate) AS last_order_ts
           FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey
"""


@register("customer_360", CUSTOMER_360_SQL)
def q_customer_360(spark, d):
    return customer_360(T(spark, d, "customer"), T(spark, d, "nation"), T(spark, d, "region"), T(spark, d, "orders"))


# --------------------------------------------------------------------- profile

ORDERS_PROFILE_COLS = [
    ("o_orderkey", "bigint", "o_orderkey"),
    ("o_custkey", "bigint", "o_custkey"),
    ("o_orderstatus", "string", "o_orderstatus"),
    ("o_totalprice", "decimal(18,2)", "CAST(o_totalprice AS DECIMAL(18,2))"),
    ("o_orderdate", "timestamp_ntz", "o_orderdate"),
    ("o_orderpriority", "string", "o_orderpriority"),
]
EVENTS_PROFILE_COLS = [
    ("event_id", "bigint", "event_id"),
    ("ts", "timestamp_ntz", "ts"),
    ("user_id", "bigint", "user_id"),
    ("event_type", "string", "event_type"),
    ("value", "decimal(18,2)", "CAST(value AS DECIMAL(18,2))"),
    ("props", "string", "props"),
]


@register("profile_orders", profile_sql("orders", ORDERS_PROFILE_COLS, "orders"))
def q_profile_orders(spark, d):
    return P.column_stats(decimal_doubles(T(spark, d, "orders")), "orders")


@register("profile_events", profile_sql("events", EVENTS_PROFILE_COLS, "events"))
def q_profile_events(spark, d):
    return P.column_stats(decimal_doubles(T(spark, d, "events")), "events")


PART_COLS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
PART_SRC = (
    "(SELECT p_partkey, p_name, p_brand, p_type, p_size, CAST(p_retailprice AS DECIMAL(18,2)) AS p_retailprice FROM part) AS p"
)


def _long_sql(cols: list[str], src: str) -> str:
    from kiln.plans.sqltext import long_values_sql

    return long_values_sql([(c, c) for c in cols], src)


TOP_VALUES_PART_SQL = f"""
WITH vc AS (SELECT column_name, value, count(*) AS cnt FROM ({_long_sql(PART_COLS, PART_SRC)}) lv GROUP BY column_name, value),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value ASC NULLS LAST) AS rnk,
             sum(cnt) OVER (PARTITION BY column_name) AS n FROM vc)
SELECT 'part' AS table_name, column_name, CAST(rnk AS INTEGER) AS rank, value, cnt AS "count",
       {ratio4_sql('cnt', 'n')} AS frequency
FROM r WHERE rnk <= 5
"""


@register("top_values_part", TOP_VALUES_PART_SQL)
def q_top_values_part(spark, d):
    return P.top_values(decimal_doubles(T(spark, d, "part")), 5, "part")


SAMPLE_VALUES_PART_SQL = f"""
WITH vc AS (SELECT DISTINCT column_name, value FROM ({_long_sql(PART_COLS, PART_SRC)}) lv WHERE value IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY value) AS rnk FROM vc)
SELECT 'part' AS table_name, column_name, CAST(rnk AS INTEGER) AS rank, value FROM r WHERE rnk <= 5
"""


@register("sample_values_part", SAMPLE_VALUES_PART_SQL)
def q_sample_values_part(spark, d):
    return P.sample_values(decimal_doubles(T(spark, d, "part")), 5, "part")


NULL_EVENTS_COLS = [
    ("event_id", "bigint", "event_id"),
    ("ts", "timestamp_ntz", "ts"),
    ("user_id", "bigint", "user_id"),
    ("event_type", "string", "nullif(event_type, 'error')"),
    ("value", "decimal(18,2)", "CAST(value AS DECIMAL(18,2))"),
    ("props", "string", "CASE WHEN event_type = 'view' THEN NULL ELSE props END"),
]


def events_with_nulls(events: DataFrame) -> DataFrame:
    return decimal_doubles(events).withColumns(
        {
            "event_type": F.nullif(F.col("event_type"), F.lit("error")),
            "props": F.when(F.col("event_type") == "view", F.lit(None)).otherwise(F.col("props")),
        }
    )



NULL_PROFILE_EVENTS_SQL = (
    "SELECT column_name, row_count, null_count, null_rate, is_unique_candidate FROM ("
    + profile_sql("events", NULL_EVENTS_COLS, "events")
    + ") AS s"
)


@register("null_profile_events", NULL_PROFILE_EVENTS_SQL)
def q_null_profile_events(spark, d):
    return P.column_stats(events_with_nulls(T(spark, d, "events")), "events").select("column_name", "row_count", "null_count", "null_rate", "is_unique_candidate")


def _null_count_sql() -> str:
    src = ", ".join(f"{expr} AS {name}" for name, _, expr in NULL_EVENTS_COLS)
    branches = [
        f"SELECT '{name}' AS column_name, count(*) AS row_count, count(*) FILTER (WHERE {name} IS NULL) AS null_count FROM s"
        for name, _, _ in NULL_EVENTS_COLS
    ]
    return (
        f"WITH s AS (SELECT {src} FROM events), c AS ({' UNION ALL '.join(branches)}) "
        f"SELECT column_name, row_count, null_count, {ratio4_sql('null_count', 'row_count')} AS null_rate FROM c"
    )


@register("null_count_events", _null_count_sql())
def q_null_count_events(spark, d):
    return P.null_count(events_with_nulls(T(spark, d, "events")))


CATALOG_COLUMNS = {
    "region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11,
    "events": 6, "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4,
}
PROFILE_CATALOG_SQL = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count, {n} AS column_count FROM {t}" for t, n in CATALOG_COLUMNS.items()
)


@register("profile_catalog", PROFILE_CATALOG_SQL)
def q_profile_catalog(spark, d):
    from kiln.sources.tables import TABLES

    return P.profile_catalog({t: T(spark, d, t) for t in TABLES})


LINEITEM_COLS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]
KEY_CANDIDATES_LINEITEM_SQL = "\nUNION ALL\n".join(
    [
        f"SELECT 'lineitem' AS table_name, '{c}' AS key_columns, count(*) AS row_count, count(*) - count({c}) AS null_rows, "
        f"count(DISTINCT {c}) AS distinct_keys FROM lineitem"
        for c in LINEITEM_COLS
    ]
    + [
        "SELECT 'lineitem', 'l_orderkey,l_linenumber', CAST(sum(n) AS BIGINT), "
        "CAST(coalesce(sum(CASE WHEN has_null = 1 THEN n END), 0) AS BIGINT), count(*) FILTER (WHERE has_null = 0) "
        "FROM (SELECT l_orderkey, l_linenumber, count(*) AS n, "
        "max(CASE WHEN l_orderkey IS NULL OR l_linenumber IS NULL THEN 1 ELSE 0 END) AS has_null "
        "FROM lineitem GROUP BY l_orderkey, l_linenumber) g"
    ]
)
KEY_CANDIDATES_LINEITEM_SQL = (
    "SELECT *, row_count - null_rows - distinct_keys AS surplus_rows, "
    "(null_rows = 0 AND distinct_keys = row_count AND row_count > 0) AS is_key FROM ("
    + KEY_CANDIDATES_LINEITEM_SQL
    + ") AS k"
)


@register("key_candidates_lineitem", KEY_CANDIDATES_LINEITEM_SQL)
def q_key_candidates_lineitem(spark, d):
    return P.key_candidates(T(spark, d, "lineitem"), [["l_orderkey", "l_linenumber"]], "lineitem")


# --------------------------------------------------------------------- clean

from kiln.operators.cleaning import apply_clean_rules  # noqa: E402
from kiln.plans.spec import CleanRule, Dedup  # noqa: E402

CLEAN_CAST_SQL = """
SELECT o_orderkey,
       CAST(trim(substr(o_orderpriority, 1, 1)) AS INTEGER) AS priority_code,
       TRY_CAST(o_orderpriority AS INTEGER) AS priority_raw,
       CAST(o_totalprice AS DECIMAL(12,2)) AS o_totalprice
FROM orders
"""


@register("clean_cast", CLEAN_CAST_SQL)
def q_clean_cast(spark, d):
    o = T(spark, d, "orders").select(
        "o_orderkey",
        F.substring("o_orderpriority", 1, 1).alias("priority_code"),
        F.col("o_orderpriority").alias("priority_raw"),
        "o_totalprice",
    )
    rules = [
        CleanRule("priority_code", ("trim_whitespace", "cast_type"), "INTEGER"),
        CleanRule("priority_raw", ("cast_type",), "INTEGER", on_error="null"),
        CleanRule("o_totalprice", ("cast_type",), "DECIMAL(12,2)"),
    ]
    return apply_clean_rules(o, rules)


DATE_TEXT_SPARK = {"F": "yyyy-MM-dd", "O": "yyyy/MM/dd", "P": "dd-MM-yyyy"}
CLEAN_DATES_SQL = r"""
WITH t AS (
  SELECT o_orderkey,
         CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d')
                            WHEN 'O' THEN strftime(o_orderdate, '%Y/%m/%d')
                            ELSE strftime(o_orderdate, '%d-%m-%Y') END AS date_text
  FROM orders)
SELECT o_orderkey, date_text,
       CAST(CASE WHEN regexp_matches(date_text, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN strptime(date_text, '%Y-%m-%d')
                 WHEN regexp_matches(date_text, '^[0-9]{4}/[0-9]{2}/[0-9]{2}$') THEN strptime(date_text, '%Y/%m/%d')
                 WHEN regexp_matches(date_text, '^[0-9]{2}-[0-9]{2}-[0-9]{4}$') THEN strptime(date_text, '%d-%m-%Y') END
            AS DATE) AS order_date
FROM t
"""


@register("clean_dates", CLEAN_DATES_SQL)
def q_clean_dates(spark, d):
    o = T(spark, d, "orders")
    text = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", DATE_TEXT_SPARK["F"]))
    text = text.when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", DATE_TEXT_SPARK["O"]))
    text = text.otherwise(F.date_format("o_orderdate", DATE_TEXT_SPARK["P"]))
    src = o.select("o_orderkey", text.alias("date_text"), text.alias("order_date"))
    return apply_clean_rules(src, [CleanRule("order_date", ("trim_whitespace", "standardize_date"))])


CLEAN_DEDUP_EVENTS_SQL = """
SELECT * FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1
"""


@register("clean_dedup_events", CLEAN_DEDUP_EVENTS_SQL)
def q_clean_dedup_events(spark, d):
    return apply_clean_rules(T(spark, d, "events"), [], Dedup(("user_id", "event_type"), ("ts", "event_id"), "last"))


CLEAN_CHAIN_SQL = """
WITH src AS (
  SELECT p_partkey, concat('  ', p_name, ' ') AS p_name, concat(' ', p_brand) AS p_brand,
         nullif(p_type, 'SMALL') AS p_type, CAST(p_size AS VARCHAR) AS p_size
  FROM part),
c AS (
  SELECT p_partkey, upper(trim(p_name)) AS p_name, lower(trim(p_brand)) AS p_brand,
         coalesce(p_type, 'UNSPECIFIED') AS p_type, CAST(trim(p_size) AS INTEGER) AS p_size
  FROM src)
SELECT * FROM c
QUALIFY row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey DESC) = 1
"""


@register("clean_chain", CLEAN_CHAIN_SQL)
def q_clean_chain(spark, d):
    p = T(spark, d, "part")
    src = p.select(
        "p_partkey",
        F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("p_name"),
        F.concat(F.lit(" "), "p_brand").alias("p_brand"),
        F.nullif(F.col("p_type"), F.lit("SMALL")).alias("p_type"),
        F.col("p_size").cast("string").alias("p_size"),
    )
    rules = [
        CleanRule("p_name", ("trim_whitespace", "uppercase")),
        CleanRule("p_brand", ("trim_whitespace", "lowercase")),
        CleanRule("p_type", ("coalesce_null",), default="UNSPECIFIED"),
        CleanRule("p_size", ("trim_whitespace", "cast_type"), "INTEGER"),
    ]
    return apply_clean_rules(src, rules, Dedup(("p_name", "p_brand"), ("p_partkey",), "last"))


# --------------------------------------------------------------------- quality

from kiln.operators import quality as Q  # noqa: E402

QC_ORDERS_SQL = """
WITH checks AS (
  SELECT 'not_null_orders_o_orderkey' AS check_name, 'orders' AS table_name, 'not_null' AS check_type, 'o_orderkey' AS field,
         CAST(count(*) FILTER (WHERE o_orderkey IS NULL) AS BIGINT) AS failures FROM orders
  UNION ALL SELECT 'not_null_orders_o_custkey', 'orders', 'not_null', 'o_custkey', count(*) FILTER (WHERE o_custkey IS NULL) FROM orders
  UNION ALL SELECT 'not_null_orders_o_orderdate', 'orders', 'not_null', 'o_orderdate', count(*) FILTER (WHERE o_orderdate IS NULL) FROM orders
  UNION ALL SELECT 'unique_orders_o_orderkey', 'orders', 'unique', 'o_orderkey',
         (SELECT count(*) FROM (SELECT o_orderkey FROM orders WHERE o_orderkey IS NOT NULL GROUP BY 1 HAVING count(*) > 1))
  UNION ALL SELECT 'unique_lineitem_l_orderkey_l_linenumber', 'lineitem', 'unique', 'l_orderkey,l_linenumber',
         (SELECT count(*) FROM (SELECT 1 FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL
                                GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
  UNION ALL SELECT 'relationships_orders_o_custkey_customer', 'orders', 'relationships', 'o_custkey',
         (SELECT count(*) FROM orders o WHERE o.o_custkey IS NOT NULL
            AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey))
  UNION ALL SELECT 'relationships_lineitem_l_orderkey_orders', 'lineitem', 'relationships', 'l_orderkey',
         (SELECT count(*) FROM lineitem l WHERE l.l_orderkey IS NOT NULL
            AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey))
  UNION ALL SELECT 'positive_totalprice', 'orders', 'custom', 'o_totalprice',
         count(*) FILTER (WHERE NOT coalesce(o_totalprice > 0, false)) FROM orders
  UNION ALL SELECT 'quantity_in_range', 'lineitem', 'custom', 'l_quantity',
         count(*) FILTER (WHERE NOT coalesce(l_quantity BETWEEN 1 AND 50, false)) FROM lineitem
)
SELECT *, CASE WHEN failures = 0 THEN 'pass' ELSE 'fail' END AS status,
       CASE WHEN failures = 0 THEN 'ok' ELSE CAST(failures AS VARCHAR) || ' failing' END AS message
FROM checks
"""


@register("qc_orders", QC_ORDERS_SQL)
def q_qc_orders(spark, d):
    o, li, c = T(spark, d, "orders"), T(spark, d, "lineitem"), T(spark, d, "customer")
    return Q.qc_report(
        [
            Q.check_rows(
                o, "orders", ["o_orderkey", "o_custkey", "o_orderdate"], [("positive_totalprice", "o_totalprice > 0", "o_totalprice")]
            ),
            Q.check_rows(li, "lineitem", custom=[("quantity_in_range", "l_quantity BETWEEN 1 AND 50", "l_quantity")]),
            Q.check_unique(o, ["o_orderkey"], "orders"),
            Q.check_unique(li, [("l_orderkey", "l_linenumber")], "lineitem"),
            Q.check_references(o, "o_custkey", c, "c_custkey", "orders", "customer"),
            Q.check_references(li, "l_orderkey", o, "o_orderkey", "lineitem", "orders"),
        ]
    )


# --------------------------------------------------------------------- pii

from kiln.operators import pii as I  # noqa: E402
from kiln.plans.sqltext import (  # noqa: E402
    key_hint_sql,
    mask_birth_sql,
    mask_default_sql,
    mask_name_sql,
    name_types_sql,
    pii_labels_sql,
    sensitive_name_sql,
)


def customer_contacts(customer: DataFrame) -> DataFrame:
    """Customer rows with contact columns derived from the key (driver data has no personal data)."""
    key = F.col("c_custkey").cast("string")
    phone = F.concat(F.lit("138"), F.lpad(key, 8, "0"))
    return customer.select(
        "c_custkey",
        "c_name",
        phone.alias("c_phone"),
        phone.alias("contact"),
        F.concat(F.lit("u"), key, F.lit("@example.com")).alias("login"),
        F.concat_ws(".", F.lit("10"), F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 256).cast("string"),
                    (F.col("c_custkey") % 200).cast("string")).alias("host_ip"),
        F.concat(F.lit("9"), F.lpad(key, 11, "0")).alias("order_no"),
        F.when(F.col("c_mktsegment") == "BUILDING", phone).otherwise(F.col("c_mktsegment")).alias("mixed"),
        "c_mktsegment",
    )


CONTACTS_SQL = """(SELECT c_custkey, c_name,
       '138' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS c_phone,
       '138' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS contact,
       'u' || CAST(c_custkey AS VARCHAR) || '@example.com' AS login,
       concat_ws('.', '10', CAST(c_nationkey AS VARCHAR), CAST(c_custkey % 256 AS VARCHAR), CAST(c_custkey % 200 AS VARCHAR)) AS host_ip,
       '9' || lpad(CAST(c_custkey AS VARCHAR), 11, '0') AS order_no,
       CASE WHEN c_mktsegment = 'BUILDING' THEN '138' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') ELSE c_mktsegment END AS mixed,
       c_mktsegment
FROM customer)"""
CONTACT_COLS = ["c_custkey", "c_name", "c_phone", "contact", "login", "host_ip", "order_no", "mixed", "c_mktsegment"]


PII_VALUES_CUSTOMER_SQL = "\nUNION ALL\n".join(
    f"SELECT c_custkey, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, {pii_labels_sql(c, key_hint_sql(c))} AS pii_types "
    f"FROM {CONTACTS_SQL} AS t"
    for c in CONTACT_COLS
)


@register("pii_values_customer", PII_VALUES_CUSTOMER_SQL)
def q_pii_values_customer(spark, d):
    return I.pii_values(customer_contacts(T(spark, d, "customer")), CONTACT_COLS, keep=["c_custkey"])


def _scan_sql() -> str:
    branches = []
    for pos, c in enumerate(CONTACT_COLS):
        branches.append(
            f"SELECT {pos} AS position, '{c}' AS column_name, {name_types_sql(c)} AS name_types, {sensitive_name_sql(c)} AS sensitive_name, "
            f"{pii_labels_sql(c, key_hint_sql(c))} AS labels FROM {CONTACTS_SQL} AS t WHERE {c} IS NOT NULL"
        )
    long = "\nUNION ALL\n".join(branches)
    return f"""
WITH v AS ({long}),
per_col AS (SELECT position, column_name, name_types, sensitive_name, count(*) AS samples,
                   count(*) FILTER (WHERE labels <> '') AS hits FROM v GROUP BY ALL),
lab AS (SELECT column_name, unnest(string_split(labels, ',')) AS label FROM v WHERE labels <> ''),
lc AS (SELECT column_name, label, count(*) AS n FROM lab GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC,
          list_position(['china_mobile','phone','email','china_idcard','bank_card','passport','ipv4','chinese_name','address'], label)) AS r FROM lc),
top AS (SELECT column_name, string_agg(label, ',' ORDER BY r) AS value_types FROM rk WHERE r <= 3 GROUP BY column_name),
j AS (SELECT p.*, t.value_types, {ratio4_sql('hits', 'samples')} AS ratio FROM per_col p LEFT JOIN top t USING (column_name))
SELECT column_name,
       CASE WHEN name_types <> '' THEN 'name' WHEN hits > 0 AND ratio >= 0.3 THEN 'value' ELSE 'none' END AS detected_by,
       samples, ratio AS pii_ratio,
       CASE WHEN name_types <> '' THEN name_types WHEN hits > 0 AND ratio >= 0.3 THEN value_types ELSE '' END AS pii_types,
       sensitive_name
FROM j
"""


@register("pii_scan_customer", _scan_sql())
def q_pii_scan_customer(spark, d):
    return I.pii_scan(customer_contacts(T(spark, d, "customer")), 0.3)


PII_TOKENS_DOCUMENTS_SQL = f"""
WITH tok AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+')) AS token FROM documents),
lab AS (SELECT doc_id, {pii_labels_sql('token', 'false')} AS labels FROM tok WHERE regexp_matches(token, '[0-9@一-鿿]')),
x AS (SELECT doc_id, unnest(string_split(labels, ',')) AS label FROM lab WHERE labels <> '')
SELECT doc_id, label, count(*) AS tokens FROM x GROUP BY ALL
"""


@register("pii_tokens_documents", PII_TOKENS_DOCUMENTS_SQL)
def q_pii_tokens_documents(spark, d):
    return I.pii_tokens(T(spark, d, "documents"), "text", keep=["doc_id"])


MASK_CUSTOMER_SQL = f"""
SELECT c_custkey, {mask_name_sql('c_name')} AS c_name, {mask_default_sql('c_phone')} AS c_phone,
       {mask_default_sql('contact')} AS contact, {mask_default_sql('login')} AS login,
       {mask_default_sql('host_ip')} AS host_ip, order_no, mixed, c_mktsegment
FROM {CONTACTS_SQL} AS t
"""


@register("mask_customer", MASK_CUSTOMER_SQL)
def q_mask_customer(spark, d):
    contacts = customer_contacts(T(spark, d, "customer"))
    return I.mask_table(contacts, I.pii_scan(contacts, 0.3))


BIRTH_TEXT_SQL = """(SELECT o_orderkey,
   CASE o_orderpriority WHEN '1-URGENT' THEN strftime(o_orderdate, '%Y-%m-%d')
                        WHEN '2-HIGH' THEN CAST(year(o_orderdate) AS VARCHAR) || '/' || CAST(month(o_orderdate) AS VARCHAR) || '/' || CAST(day(o_orderdate) AS VARCHAR)
                        WHEN '3-MEDIUM' THEN CAST(year(o_orderdate) AS VARCHAR) || '-' || CAST(month(o_orderdate) AS VARCHAR) || '/' || CAST(day(o_orderdate) AS VARCHAR)
                        ELSE strftime(o_orderdate, '%Y%m%d') END AS birth_date
 FROM orders)"""

MASK_BIRTH_DATES_SQL = f"SELECT o_orderkey, birth_date AS birth_date_raw, {mask_birth_sql('birth_date')} AS birth_date FROM {BIRTH_TEXT_SQL} AS t"


@register("mask_birth_dates", MASK_BIRTH_DATES_SQL)
def q_mask_birth_dates(spark, d):
    o = T(spark, d, "orders")
    y, m, dd = (F.year("o_orderdate").cast("string"), F.month("o_orderdate").cast("string"), F.dayofmonth("o_orderdate").cast("string"))
    p = F.col("o_orderpriority")
    text = (
        F.when(p == "1-URGENT", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(p == "2-HIGH", F.concat_ws("/", y, m, dd))
        .when(p == "3-MEDIUM", F.concat(y, F.lit("-"), m, F.lit("/"), dd))
        .otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    )
    src = o.select("o_orderkey", text.alias("birth_date_raw"), text.alias("birth_date"))
    return I.mask_table(src, {"birth_date": []})


# --------------------------------------------------------------------- map layer

from kiln.operators import mapping as M  # noqa: E402
from kiln.plans.spec import Field, Mapping, Standard  # noqa: E402


def party_stack(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    """Customers and suppliers as one party entity (M8), keys and names merged."""
    cust = customer.select(
        F.concat(F.lit("CUST-"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("key_text"),
        "c_name", F.col("c_nationkey").alias("nation_key"), "c_acctbal", "c_mktsegment",
    )
    supp = supplier.select(F.col("s_suppkey").alias("party_id"), "s_name", F.col("s_nationkey").alias("nation_key"), "s_acctbal")
    stacked = M.stack_sources({"customer": cust, "supplier": supp})
    maps = [
        Mapping("source_table", "direct", source_field="source_table"),
        Mapping("party_key", "merge", sources=("try_cast(regexp_extract(key_text, '([0-9]+)$', 1) AS BIGINT)", "party_id")),
        Mapping("party_name", "merge", sources=("c_name", "s_name")),
        Mapping("nation_key", "direct", source_field="nation_key"),
        Mapping("balance", "merge", sources=("CAST(c_acctbal AS DECIMAL(15,2))", "CAST(s_acctbal AS DECIMAL(15,2))")),
        Mapping("label", "merge", sources=("source_table", "c_mktsegment"), merge_how="concat"),
    ]
    return M.build_map(stacked, maps)


MERGE_KEYS_UNION_SQL = """
SELECT 'customer' AS source_table, c_custkey AS party_key, c_name AS party_name, c_nationkey AS nation_key,
       CAST(c_acctbal AS DECIMAL(15,2)) AS balance, 'customer ' || c_mktsegment AS label FROM customer
UNION ALL
SELECT 'supplier', s_suppkey, s_name, s_nationkey, CAST(s_acctbal AS DECIMAL(15,2)), 'supplier' FROM supplier
"""


@register("merge_keys_union", MERGE_KEYS_UNION_SQL)
def q_merge_keys_union(spark, d):
    return party_stack(T(spark, d, "customer"), T(spark, d, "supplier"))


NORMALISE_KEYS_SQL = """
WITH emr AS (SELECT o_orderkey, 'MRN-' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS patient_mrn FROM orders)
SELECT e.o_orderkey, e.patient_mrn, CAST(regexp_extract(e.patient_mrn, '([0-9]+)$', 1) AS BIGINT) AS customer_key, c.c_name
FROM emr e LEFT JOIN customer c ON c.c_custkey = CAST(regexp_extract(e.patient_mrn, '([0-9]+)$', 1) AS BIGINT)
"""


@register("normalise_keys", NORMALISE_KEYS_SQL)
def q_normalise_keys(spark, d):
    emr = T(spark, d, "orders").select(
        "o_orderkey", F.concat(F.lit("MRN-"), F.lpad(F.col("o_custkey").cast("string"), 6, "0")).alias("patient_mrn")
    )
    keyed = emr.withColumn("customer_key", M.normalise_key("patient_mrn"))
    return M.enrich(keyed, T(spark, d, "customer"), "customer_key", "c_custkey", ["c_name"])


FANOUT_SQL = """
WITH direct AS (SELECT o.o_orderkey FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey),
pre AS (SELECT o.o_orderkey FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) a
        ON o.o_orderkey = a.l_orderkey),
s AS (SELECT 'direct_join' AS plan, o_orderkey, count(*) AS n FROM direct GROUP BY 1, 2
      UNION ALL SELECT 'preaggregated', o_orderkey, count(*) FROM pre GROUP BY 1, 2)
SELECT plan, (SELECT count(*) FROM orders) AS base_rows, CAST(sum(n) AS BIGINT) AS joined_rows,
       count(*) FILTER (WHERE n > 1) AS repeated_keys, CAST(max(n) AS BIGINT) AS max_rows_per_key,
       sum(n) > (SELECT count(*) FROM orders) AS inflated
FROM s GROUP BY plan
"""


@register("fanout_orders_lineitem", FANOUT_SQL)
def q_fanout(spark, d):
    o, li = T(spark, d, "orders").select("o_orderkey"), T(spark, d, "lineitem")
    direct = o.join(li, o.o_orderkey == li.l_orderkey)
    pre = M.preaggregate_join(o, li, "o_orderkey", "l_orderkey", {"n": F.count(F.lit(1))})
    a = M.fanout_audit(o, direct, "o_orderkey").select(F.lit("direct_join").alias("plan"), "*")
    b = M.fanout_audit(o, pre, "o_orderkey").select(F.lit("preaggregated").alias("plan"), "*")
    return a.unionByName(b)


PART_TARGET = Standard(
    "dim_part",
    (
        Field("part_id", "BIGINT", False),
        Field("part_name", "VARCHAR(55)", False),
        Field("brand", "VARCHAR(10)"),
        Field("size", "INTEGER"),
        Field("suppliers", "BIGINT"),
        Field("color", "VARCHAR(20)"),
    ),
)

GAP_FILL_PART_SQL = """
SELECT p.p_partkey AS part_id, p.p_name AS part_name, p.p_brand AS brand, CAST(p.p_size AS INTEGER) AS size,
       CAST(coalesce(s.suppliers, 0) AS BIGINT) AS suppliers, CAST(NULL AS VARCHAR) AS color
FROM part p LEFT JOIN (SELECT l_partkey, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1) s
  ON p.p_partkey = s.l_partkey
"""


@register("gap_fill_part", GAP_FILL_PART_SQL)
def q_gap_fill_part(spark, d):
    p, li = T(spark, d, "part"), T(spark, d, "lineitem")
    kept = [Mapping("p_brand"), Mapping("p_size")]  # what the gaps will need from the same table
    base = M.build_map(
        p, [Mapping("part_id", "direct", source_field="p_partkey"), Mapping("part_name", "direct", source_field="p_name"), *kept]
    )
    # the supplier count lives in another table: pre-aggregate it and join first
    base = M.preaggregate_join(base, li, "part_id", "l_partkey", {"supp_n": F.count_distinct("l_suppkey")}, zero_fill=("supp_n",))
    gaps = [
        Mapping("brand", "direct", "part", "p_brand"),
        Mapping("size", "transform", "part", "p_size", "CAST(p_size AS INT)"),
        Mapping("suppliers", "direct", "lineitem", "supp_n"),
        Mapping("color", "direct", "part", "p_color"),  # no such column: filled as typed NULL
    ]
    from kiln.operators.standard import conform

    return conform(M.gap_fill(base, gaps, PART_TARGET), PART_TARGET)


ORDER_LINES = Standard(
    "fct_order",
    (
        Field("order_id", "BIGINT", False),
        Field("line_count", "BIGINT", False),
        Field("revenue", "DECIMAL(18,2)", False),
        Field("last_ship_date", "DATE", False),
        Field("status", "VARCHAR(1)", True),
    ),
)


def order_lines_model(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    agg = {
        "line_count": F.count(F.lit(1)),
        "revenue": F.sum(F.col("l_extendedprice").cast("decimal(18,2)")),
        "last_ship": F.max("l_shipdate"),
    }
    j = M.preaggregate_join(orders, lineitem, "o_orderkey", "l_orderkey", agg, zero_fill=("line_count",))
    return M.build_map(
        j,
        [
            Mapping("order_id", "direct", source_field="o_orderkey"),
            Mapping("line_count", "direct", source_field="line_count"),
            Mapping("revenue", "transform", expr="CAST(revenue AS DECIMAL(18,2))"),
            Mapping("last_ship_date", "transform", expr="CAST(last_ship AS DATE)"),
            Mapping("status", "direct", source_field="o_orderstatus"),
        ],
    )


NOT_NULL_AUDIT_SQL = """
WITH m AS (SELECT o.o_orderkey, coalesce(a.n, 0) AS line_count, a.revenue, a.last_ship
           FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS revenue,
                                           max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1) a ON o.o_orderkey = a.l_orderkey),
w AS (SELECT count(*) FILTER (WHERE o_orderkey IS NULL) AS order_id, count(*) FILTER (WHERE line_count IS NULL) AS line_count,
             count(*) FILTER (WHERE revenue IS NULL) AS revenue, count(*) FILTER (WHERE last_ship IS NULL) AS last_ship_date FROM m)
SELECT * FROM (
  SELECT 'order_id' AS field, order_id AS null_rows FROM w UNION ALL SELECT 'line_count', line_count FROM w
  UNION ALL SELECT 'revenue', revenue FROM w UNION ALL SELECT 'last_ship_date', last_ship_date FROM w) t
WHERE null_rows > 0
"""


@register("not_null_audit", NOT_NULL_AUDIT_SQL)
def q_not_null_audit(spark, d):
    return M.unprotected_not_null(order_lines_model(T(spark, d, "orders"), T(spark, d, "lineitem")), ORDER_LINES)


BUCKET_PRICES_SQL = """
SELECT o_orderkey, CASE WHEN o_totalprice IS NULL THEN NULL WHEN o_totalprice < 50000 THEN 'small'
                        WHEN o_totalprice < 150000 THEN 'medium' WHEN o_totalprice < 300000 THEN 'large' ELSE 'huge' END AS price_band
FROM orders
"""


@register("bucket_prices", BUCKET_PRICES_SQL)
def q_bucket_prices(spark, d):
    o = T(spark, d, "orders")
    return o.select("o_orderkey", M.bucket("o_totalprice", [50000, 150000, 300000], ["small", "medium", "large", "huge"]).alias("price_band"))


ORDER_DATES_SQL = """
SELECT o_orderkey, year(o_orderdate) AS order_year,
       CAST(2002 - year(o_orderdate) - CASE WHEN 1 < month(o_orderdate) OR (1 = month(o_orderdate) AND 1 < day(o_orderdate))
                                             THEN 1 ELSE 0 END AS INTEGER) AS age_years,
       CASE WHEN o_orderstatus IS NULL THEN NULL WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS is_open,
       coalesce(CAST(o_totalprice AS DECIMAL(12,2)), CAST(0 AS DECIMAL(12,2))) AS total_price
FROM orders
"""


@register("order_dates", ORDER_DATES_SQL)
def q_order_dates(spark, d):
    o = T(spark, d, "orders")
    return o.select(
        "o_orderkey",
        M.year_of("o_orderdate").alias("order_year"),
        M.age_years(F.col("o_orderdate").cast("date"), F.lit("2002-01-01").cast("date")).alias("age_years"),
        M.flag("o_orderstatus", "O").alias("is_open"),
        M.cast_nullsafe("o_totalprice", "DECIMAL(12,2)", 0).alias("total_price"),
    )


# --------------------------------------------------------------------- standard

from kiln.operators.standard import coverage_audit, readiness  # noqa: E402

CUSTOMER_TARGET = Standard(
    "dim_customer_target",
    (
        Field("customer_id", "BIGINT", False),
        Field("customer_name", "VARCHAR(25)", False),
        Field("phone", "VARCHAR(20)"),
        Field("nation_name", "VARCHAR(25)"),
        Field("market_segment", "VARCHAR(10)"),
        Field("account_balance", "DOUBLE"),
        Field("order_count", "BIGINT"),
        Field("last_order_date", "DATE"),
        Field("email", "VARCHAR(100)"),
        Field("birth_date", "DATE"),
    ),
)
_TYPES_360 = {
    "customer_id": "bigint", "customer_name": "string", "nation_name": "string", "market_segment": "string",
    "account_balance": "decimal(15,2)", "order_count": "bigint", "last_order_date": "date", "email": "string",
}


def _coverage_sql() -> str:
    from kiln.plans.spec import spark_type

    parts = []
    for pos, f in enumerate(CUSTOMER_TARGET.fields):
        exp = spark_type(f.data_type)
        got = _TYPES_360.get(f.name)
        filled = f"count({f.name})" if got else "0"
        parts.append(
            f"SELECT 'dim_customer_target' AS table_name, {pos} AS position, '{f.name}' AS field_name, {str(bool(got)).lower()} AS present, "
            f"count(*) AS row_count, CAST({filled} AS BIGINT) AS filled_rows, {ratio4_sql(filled, 'count(*)')} AS fill_rate, "
            f"'{exp}' AS expected_type, {repr(got) if got else 'CAST(NULL AS VARCHAR)'} AS actual_type, "
            f"{str(got == exp).lower()} AS type_match, {str(f.nullable).lower()} AS nullable FROM ({CUSTOMER_360_SQL}) m"
        )
    return "\nUNION ALL\n".join(parts)


COVERAGE_CUSTOMER_SQL = _coverage_sql()


@register("coverage_customer", COVERAGE_CUSTOMER_SQL)
def q_coverage_customer(spark, d):
    return coverage_audit(q_customer_360(spark, d), CUSTOMER_TARGET)


READINESS_SQL = f"""
WITH cov AS ({COVERAGE_CUSTOMER_SQL}),
t AS (SELECT table_name, count(*) AS fields, count(*) FILTER (WHERE NOT present) AS uncovered,
             sum(CAST(round(CASE WHEN present THEN fill_rate ELSE 0.0 END * 10000) AS BIGINT)) AS units FROM cov GROUP BY 1)
SELECT table_name, fields, uncovered, {ratio4_sql('units', 'fields * 10000')} AS confidence,
       CASE WHEN {ratio4_sql('units', 'fields * 10000')} >= 0.9 AND uncovered = 0 THEN 'auto'
            WHEN {ratio4_sql('units', 'fields * 10000')} >= 0.7 AND uncovered <= 3 THEN 'suggest' ELSE 'manual' END AS recommendation
FROM t
"""


@register("readiness", READINESS_SQL)
def q_readiness(spark, d):
    return readiness(q_coverage_customer(spark, d))


# --------------------------------------------------------------------- sql model

from kiln.sources.model import run_model  # noqa: E402
from kiln.sources.tables import row_view  # noqa: E402

REVENUE_MODEL = """
SELECT n.n_name AS nation, year(o.o_orderdate) AS order_year, count(DISTINCT o.o_orderkey) AS orders,
       sum(CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2)))) AS revenue
FROM {{ source('tpch', 'orders') }} o
JOIN {{ source('tpch', 'lineitem') }} l ON l.l_orderkey = o.o_orderkey
JOIN {{ source('tpch', 'customer') }} c ON c.c_custkey = o.o_custkey
JOIN {{ source('tpch', 'nation') }} n ON n.n_nationkey = c.c_nationkey
GROUP BY n.n_name, year(o.o_orderdate)
"""
SQL_MODEL_REVENUE_SQL = (
    REVENUE_MODEL.replace("{{ source('tpch', 'orders') }}", "orders")
    .replace("{{ source('tpch', 'lineitem') }}", "lineitem")
    .replace("{{ source('tpch', 'customer') }}", "customer")
    .replace("{{ source('tpch', 'nation') }}", "nation")
)


@register("sql_model_revenue", SQL_MODEL_REVENUE_SQL)
def q_sql_model_revenue(spark, d):
    inputs = {}
    for t in ("orders", "lineitem", "customer", "nation"):
        df = T(spark, d, t)
        row_view(spark, "tpch", t, df)  # S1: the row layer stays a lazy view
        inputs[("tpch", t)] = spark.table(f"row_tpch_{t}")
    return run_model(spark, REVENUE_MODEL, inputs)


# --------------------------------------------------------------------- sync and delivery

from kiln.operators import delivery as D  # noqa: E402
from kiln.session import shared_dir  # noqa: E402
from kiln.sources.ods import sync_to_ods, write_table  # noqa: E402

ODS_SYNC_SQL = """
SELECT 'tpch' AS source_id, 'customer' AS table_name, 'ods_tpch.customer' AS target, 'success' AS status,
       count(*) AS rows_copied, count(*) AS read_back_rows FROM customer
UNION ALL SELECT 'tpch', 'nation', 'ods_tpch.nation', 'success', count(*), count(*) FROM nation
UNION ALL SELECT 'tpch', 'orders', 'ods_tpch.orders', 'success', count(*), count(*) FROM orders
UNION ALL SELECT 'tpch', 'partsupp', 'ods_tpch.partsupp', 'skipped', NULL, NULL
"""


@register("ods_sync", ODS_SYNC_SQL)
def q_ods_sync(spark, d):
    tables = {"customer": T(spark, d, "customer"), "orders": T(spark, d, "orders"), "nation": T(spark, d, "nation"), "partsupp": None}
    res = sync_to_ods(spark, "tpch", tables)
    synced = [r.table_name for r in res.filter("status = 'success'").select("table_name").collect()]  # table names only
    back = None
    for t in synced:
        part = spark.table(f"ods_tpch.{t}").agg(F.count(F.lit(1)).alias("read_back_rows")).select(F.lit(t).alias("table_name"), "read_back_rows")
        back = part if back is None else back.unionByName(part)
    out = res.join(back, "table_name", "left") if back is not None else res.withColumn("read_back_rows", F.lit(None).cast("long"))
    return out.select("source_id", "table_name", "target", "status", "rows_copied", "read_back_rows")


@register("deliver_replace", CUSTOMER_360_SQL)
def q_deliver_replace(spark, d):
    write_table(q_customer_360(spark, d), "clean", "clean_dim_customer_r")
    res = D.deliver(spark, {"clean_dim_customer_r": "clean.clean_dim_customer_r"}, "replace", prod_db="prod")
    if res.filter("status <> 'success'").count():
        raise RuntimeError(res.collect())
    return spark.table("prod.dim_customer_r")


@register("deliver_atomic", CLEAN_CHAIN_SQL)
def q_deliver_atomic(spark, d):
    write_table(q_clean_chain(spark, d), "clean", "clean_part_a")
    res = D.deliver(spark, {"clean_part_a": "clean.clean_part_a"}, "atomic", prod_db="prod")
    if res.filter("status <> 'success'").count():
        raise RuntimeError(res.collect())
    return spark.table("prod.part_a")


@register("deliver_copy", "SELECT * FROM customer")
def q_deliver_copy(spark, d):
    root = shared_dir(spark, "copy_target")
    res = D.deliver(spark, {"clean_customer": T(spark, d, "customer")}, "copy", copy_root=root)
    if res.filter("status <> 'success'").count():
        raise RuntimeError(res.collect())
    return spark.read.parquet(f"{root}/customer")


DELIVERY_SUMMARY_SQL = """
SELECT 'clean_dim_customer_s' AS clean_table, 'dim_customer_s' AS prod_table, 'replace' AS strategy, 'success' AS status,
       count(*) AS "rows" FROM customer
UNION ALL SELECT 'clean_missing_s', 'missing_s', 'replace', 'failed', NULL
UNION ALL SELECT 'clean_order_lines_s', 'order_lines_s', 'replace', 'success', count(*) FROM orders
"""


@register("delivery_summary", DELIVERY_SUMMARY_SQL)
def q_delivery_summary(spark, d):
    tables = {
        "clean_dim_customer_s": q_customer_360(spark, d),
        "clean_order_lines_s": order_lines_model(T(spark, d, "orders"), T(spark, d, "lineitem")),
        "clean_missing_s": "clean.no_such_table",
    }
    res = D.deliver(spark, tables, "replace", prod_db="prod")
    return res.select("clean_table", "prod_table", "strategy", "status", "rows")


RUN_HISTORY_SQL = """
WITH dedup AS (SELECT * FROM lineitem
               QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC) = 1),
r AS (
  SELECT 1 AS run_id, 'check' AS kind, 'unique_lineitem_l_orderkey_l_linenumber' AS item,
         (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS value
  UNION ALL SELECT 1, 'check', 'not_null_lineitem_l_orderkey', count(*) FILTER (WHERE l_orderkey IS NULL) FROM lineitem
  UNION ALL SELECT 1, 'rows', 'lineitem', count(*) FROM lineitem
  UNION ALL SELECT 2, 'check', 'unique_lineitem_l_orderkey_l_linenumber',
         (SELECT count(*) FROM (SELECT 1 FROM dedup GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
  UNION ALL SELECT 2, 'check', 'not_null_lineitem_l_orderkey', count(*) FILTER (WHERE l_orderkey IS NULL) FROM dedup
  UNION ALL SELECT 2, 'rows', 'lineitem', count(*) FROM dedup)
SELECT kind, item, CAST(run_id AS BIGINT) AS run_id, CAST(value AS BIGINT) AS value,
       CAST(lag(value) OVER (PARTITION BY kind, item ORDER BY run_id) AS BIGINT) AS previous_value,
       CAST(value - lag(value) OVER (PARTITION BY kind, item ORDER BY run_id) AS BIGINT) AS change
FROM r
"""


@register("run_history", RUN_HISTORY_SQL)
def q_run_history(spark, d):
    import uuid

    path = shared_dir(spark, "history", uuid.uuid4().hex)
    li = T(spark, d, "lineitem")
    runs = {1: li, 2: apply_clean_rules(li, [], Dedup(("l_orderkey", "l_linenumber"), ("l_partkey", "l_suppkey"), "last"))}
    for run_id, df in runs.items():
        checks = Q.check_unique(df, [("l_orderkey", "l_linenumber")], "lineitem").unionByName(
            Q.check_not_null(df, ["l_orderkey"], "lineitem")
        )
        D.append_history(spark, path, checks.select(F.col("check_name").alias("item"), F.col("failures").alias("value")), run_id, "check")
        D.append_history(spark, path, df.agg(F.count(F.lit(1)).alias("value")).select(F.lit("lineitem").alias("item"), "value"), run_id, "rows")
    return D.compare_runs(spark.read.parquet(path))


LINEITEM_PROFILE_COLS = [
    (c, "decimal(18,2)" if c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax") else t,
     f"CAST({c} AS DECIMAL(18,2))" if c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax") else c)
    for c, t in [
        ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
        ("l_quantity", ""), ("l_extendedprice", ""), ("l_discount", ""), ("l_tax", ""),
        ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz"),
    ]
]


@register("profile_lineitem", profile_sql("lineitem", LINEITEM_PROFILE_COLS, "lineitem"))
def q_profile_lineitem(spark, d):
    return P.column_stats(decimal_doubles(T(spark, d, "lineitem")), "lineitem")


# --------------------------------------------------------------------- more coverage

from kiln.functions.pii import DIVISION_STOP_CHARS, DIVISION_WORDS  # noqa: E402


def customer_addresses(customer: DataFrame) -> DataFrame:
    """Addresses built from customer rows (driver data holds no Chinese text)."""
    head = (
        F.when(F.col("c_nationkey") % 4 == 0, F.lit("北京市朝阳区"))
        .when(F.col("c_nationkey") % 4 == 1, F.lit("浙江省杭州市西湖区"))
        .when(F.col("c_nationkey") % 4 == 2, F.lit("广东省深圳市"))
        .otherwise(F.lit("某某"))
    )
    tail = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("")).otherwise(
        F.concat(F.lit("建国路"), F.col("c_custkey").cast("string"), F.lit("号"))
    )
    return customer.select("c_custkey", F.concat(head, tail).alias("home_address"))


_ADDR_HEAD = f"regexp_extract(a, '^(.*[^{DIVISION_STOP_CHARS}\\s](?:{DIVISION_WORDS}))', 1)"
MASK_ADDRESS_CUSTOMER_SQL = f"""
WITH t AS (SELECT c_custkey,
    (CASE c_nationkey % 4 WHEN 0 THEN '北京市朝阳区' WHEN 1 THEN '浙江省杭州市西湖区' WHEN 2 THEN '广东省深圳市' ELSE '某某' END)
    || (CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE '建国路' || CAST(c_custkey AS VARCHAR) || '号' END) AS a FROM customer),
h AS (SELECT c_custkey, a, {_ADDR_HEAD} AS head FROM t)
SELECT c_custkey,
  CASE WHEN a IS NULL THEN NULL WHEN length(a) <= 1 THEN '*'
       WHEN length(head) = 0 THEN (CASE WHEN length(a) <= 4 THEN substr(a, 1, 1) || repeat('*', length(a) - 1)
                                        ELSE substr(a, 1, 2) || repeat('*', length(a) - 2) END)
       WHEN length(head) >= length(a) - 1 THEN a
       ELSE head || repeat('*', greatest(4, length(a) - length(head))) END AS home_address
FROM h
"""


@register("mask_address_customer", MASK_ADDRESS_CUSTOMER_SQL)
def q_mask_address_customer(spark, d):
    addr = customer_addresses(T(spark, d, "customer"))
    return I.mask_table(addr, I.pii_scan(addr, 0.3))


PART_PROFILE_COLS = [
    ("p_partkey", "bigint", "p_partkey"),
    ("p_name", "string", "p_name"),
    ("p_brand", "string", "p_brand"),
    ("p_type", "string", "p_type"),
    ("p_size", "int", "p_size"),
    ("p_retailprice", "decimal(18,2)", "CAST(p_retailprice AS DECIMAL(18,2))"),
]
PROFILE_PART_SQL = f"""
WITH st AS ({profile_sql("part", PART_PROFILE_COLS, "part")}),
top AS (SELECT column_name, string_agg(coalesce(value, 'NULL') || '=' || "count", ' | ' ORDER BY rank) AS top_values
        FROM ({TOP_VALUES_PART_SQL}) AS tv GROUP BY column_name),
sam AS (SELECT column_name, string_agg(value, ' | ' ORDER BY rank) AS sample_values FROM ({SAMPLE_VALUES_PART_SQL}) AS sv GROUP BY column_name)
SELECT st.*, top.top_values, sam.sample_values FROM st JOIN top USING (column_name) JOIN sam USING (column_name)
"""


@register("profile_part", PROFILE_PART_SQL)
def q_profile_part(spark, d):
    """P9 in full: stats plus bounded top-value and sample arrays per column, the arrays written as text."""
    full = P.profile_table(decimal_doubles(T(spark, d, "part")), "part", k=5)
    top = F.transform("top_values", lambda t: F.concat(F.coalesce(t["value"], F.lit("NULL")), F.lit("="), t["count"].cast("string")))
    return full.withColumns({"top_values": F.array_join(top, " | "), "sample_values": F.array_join("sample_values", " | ")})


ATTACH_TPCH_SQL = "\nUNION ALL\n".join(
    f"SELECT 'src_tpch_{t}' AS view_name, count(*) AS row_count FROM {t}" for t in CATALOG_COLUMNS
)


@register("attach_tpch", ATTACH_TPCH_SQL)
def q_attach_tpch(spark, d):
    from kiln.sources.attach import attach_source

    views = attach_source(spark, {"id": "tpch", "format": "parquet", "path": d})
    out = None
    for v in views:
        part = spark.table(v).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(v).alias("view_name"), "row_count")
        out = part if out is None else out.unionByName(part)
    return out


CONTACT_PROFILE_COLS = [("c_custkey", "bigint", "c_custkey")] + [(c, "string", c) for c in CONTACT_COLS[1:]]
_MASKED = {"c_name": mask_name_sql, "c_phone": mask_default_sql, "contact": mask_default_sql,
           "login": mask_default_sql, "host_ip": mask_default_sql}


def _masked_profile_sql() -> str:
    def case(col: str) -> str:
        parts = " ".join(f"WHEN column_name = '{c}' THEN {fn(col)}" for c, fn in _MASKED.items())
        return f"CASE {parts} ELSE {col} END"

    base = profile_sql("customer", CONTACT_PROFILE_COLS, f"{CONTACTS_SQL} AS src")
    return (
        "SELECT table_name, position, column_name, data_type, row_count, null_count, null_rate, unique_count, "
        f"is_unique_candidate, {case('min_value')} AS min_value, {case('max_value')} AS max_value FROM ({base}) AS p"
    )


@register("profile_masked_customer", _masked_profile_sql())
def q_profile_masked_customer(spark, d):
    contacts = customer_contacts(T(spark, d, "customer"))
    counts = P.value_counts(contacts)  # grouped once for both
    return I.mask_profile(P.column_stats(contacts, "customer", counts=counts), I.pii_scan(contacts, 0.3, counts=counts))


PROFILE_APPROX_SQL = (
    "SELECT table_name, position, column_name, data_type, row_count, null_count, null_rate, min_value, max_value, "
    f"true AS estimate_in_range FROM ({profile_sql('lineitem', LINEITEM_PROFILE_COLS, 'lineitem')}) AS p"
)


@register("profile_lineitem_approx", PROFILE_APPROX_SQL)
def q_profile_lineitem_approx(spark, d):
    """P1-P6 with HyperLogLog distinct counts: one wide aggregate, no value shuffle (the 100 TB setting).

    The exact columns, and whether the estimate lies within the possible range and its error.
    """
    most = F.col("row_count") * (1 + P.SKETCH_SIGMAS * P.SKETCH_RSD)
    stats = P.column_stats(decimal_doubles(T(spark, d, "lineitem")), "lineitem", approx=True)
    return stats.withColumn("estimate_in_range", F.col("unique_count").between(1, most)).drop("unique_count", "is_unique_candidate")


SKETCH_ERROR_SQL = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS exact, true AS within_error, "
    f"(count(DISTINCT {c}) = count(*) AND count(*) > 0) AS is_key FROM lineitem"
    for c in LINEITEM_COLS
)


@register("sketch_error_lineitem", SKETCH_ERROR_SQL)
def q_sketch_error_lineitem(spark, d):
    """P4 and P5 both ways: every estimate lies within the sketch's error of the exact count."""
    li = T(spark, d, "lineitem")
    guess = P.unique_count(li, approx=True).select("column_name", F.col("unique_count").alias("guess"))
    both = P.unique_count(li).join(F.broadcast(guess), "column_name")  # one row per column
    near = F.abs(F.col("guess") - F.col("unique_count")) <= P.SKETCH_SIGMAS * P.SKETCH_RSD * F.col("unique_count")
    return both.select("column_name", F.col("unique_count").alias("exact"), near.alias("within_error"), F.col("is_unique_candidate").alias("is_key"))


PROFILE_EMBEDDINGS_SQL = f"""
SELECT 'embeddings' AS table_name, 0 AS position, 'vec_id' AS column_name, 'bigint' AS data_type, count(*) AS row_count,
       count(*) - count(vec_id) AS null_count, {ratio4_sql('count(*) - count(vec_id)', 'count(*)')} AS null_rate,
       count(DISTINCT vec_id) AS unique_count, (count(DISTINCT vec_id) = count(*) AND count(*) > 0) AS is_unique_candidate,
       CAST(min(vec_id) AS VARCHAR) AS min_value, CAST(max(vec_id) AS VARCHAR) AS max_value FROM embeddings
UNION ALL
SELECT 'embeddings', 1, 'embedding', 'array<float>', count(*), count(*) - count(embedding),
       {ratio4_sql('count(*) - count(embedding)', 'count(*)')}, CAST(NULL AS BIGINT), false,
       CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM embeddings
UNION ALL
SELECT 'embeddings', 2, 'label', 'int', count(*), count(*) - count(label), {ratio4_sql('count(*) - count(label)', 'count(*)')},
       count(DISTINCT label), (count(DISTINCT label) = count(*) AND count(*) > 0),
       CAST(min(label) AS VARCHAR), CAST(max(label) AS VARCHAR) FROM embeddings
"""


@register("profile_embeddings", PROFILE_EMBEDDINGS_SQL)
def q_profile_embeddings(spark, d):
    """Vectors are counted only (no distinct values or ranges for arrays)."""
    return P.column_stats(T(spark, d, "embeddings"), "embeddings")


PII_TOKENS_CONVERSATIONS_SQL = f"""
WITH tok AS (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+')) AS token FROM conversations),
lab AS (SELECT conv_id, turn, {pii_labels_sql('token', 'false')} AS labels FROM tok WHERE regexp_matches(token, '[0-9@一-鿿]')),
x AS (SELECT conv_id, turn, unnest(string_split(labels, ',')) AS label FROM lab WHERE labels <> '')
SELECT conv_id, turn, label, count(*) AS tokens FROM x GROUP BY ALL
"""


@register("pii_tokens_conversations", PII_TOKENS_CONVERSATIONS_SQL)
def q_pii_tokens_conversations(spark, d):
    return I.pii_tokens(T(spark, d, "conversations"), "text", keep=["conv_id", "turn"])


PII_TOKENS_PAGES_SQL = f"""
WITH t AS (SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS body FROM pages),
tok AS (SELECT page_id, unnest(regexp_split_to_array(body, '[ \\t\\n\\r\\f]+')) AS token FROM t),
lab AS (SELECT page_id, {pii_labels_sql('token', 'false')} AS labels FROM tok WHERE regexp_matches(token, '[0-9@一-鿿]')),
x AS (SELECT page_id, unnest(string_split(labels, ',')) AS label FROM lab WHERE labels <> '')
SELECT page_id, label, count(*) AS tokens FROM x GROUP BY ALL
"""


@register("pii_tokens_pages", PII_TOKENS_PAGES_SQL)
def q_pii_tokens_pages(spark, d):
    """Page text is the HTML with its tags replaced by spaces; every whole page is scanned."""
    pages = T(spark, d, "pages").select("page_id", F.regexp_replace("html", "<[^>]*>", " ").alias("body"))
    return I.pii_tokens(pages, "body", keep=["page_id"])


# --------------------------------------------------------------------- source explore

from kiln.plans.explore import explore  # noqa: E402
from kiln.plans.sqltext import mask_address_sql, scan_sql  # noqa: E402

STAR_SCHEMAS = {
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
                 ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
                 ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
               ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int"),
             ("p_retailprice", "double")],
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")],
    "events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"), ("value", "double"),
               ("props", "string")],
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")],
    "embeddings": [("vec_id", "bigint"), ("embedding", "array<float>"), ("label", "int")],
    "pages": [("page_id", "bigint"), ("url", "string"), ("html", "string")],
    "benchmark": [("item_id", "bigint"), ("text", "string")],
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
    "conversations": [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string")],
}


def _explore_sql() -> str:
    masks = {"name": mask_name_sql, "address": mask_address_sql, "birth_date": mask_birth_sql, "default": mask_default_sql}
    stats, scans = [], []
    for t, cols in STAR_SCHEMAS.items():
        typed = [(c, "decimal(18,2)" if k == "double" else k, f"CAST({c} AS DECIMAL(18,2))" if k == "double" else c) for c, k in cols]
        src = f"(SELECT {', '.join(f'{e} AS {c}' for c, _, e in typed)} FROM {t})"
        stats.append(profile_sql(t, typed, f"{src} AS s"))
        scans.append(scan_sql(t, [(c, c) for c, k, _ in typed if not k.startswith("array")], f"{src} AS s"))

    def masked(col: str) -> str:
        kinds = " ".join(f"WHEN c.mask_kind = '{k}' THEN {fn(col)}" for k, fn in masks.items())
        return f"CASE WHEN c.detected_by <> 'none' OR c.sensitive_name THEN (CASE {kinds} END) ELSE {col} END"

    return f"""
WITH st AS ({' UNION ALL '.join(f'({s})' for s in stats)}),
c AS ({' UNION ALL '.join(f'SELECT * FROM {s} AS x' for s in scans)})
SELECT st.table_name, st.position, st.column_name, st.data_type, st.row_count, st.null_count, st.null_rate, st.unique_count,
       st.is_unique_candidate, {masked('st.min_value')} AS min_value, {masked('st.max_value')} AS max_value,
       c.detected_by, c.pii_types
FROM st LEFT JOIN c ON st.table_name = c.table_name AND st.column_name = c.column_name
"""


@register("explore_tpch", _explore_sql())
def q_explore_tpch(spark, d):
    src = {"id": "tpch", "format": "parquet", "path": d}
    return explore(spark, src, prepare=decimal_doubles).columns


CATALOG_SUMMARY_SQL = f"""
SELECT count(*) AS total_tables, CAST(sum(row_count) AS BIGINT) AS total_rows, CAST(sum(column_count) AS BIGINT) AS total_columns,
       CAST(0 AS BIGINT) AS tables_left_out FROM ({PROFILE_CATALOG_SQL}) AS c
"""


@register("catalog_summary", CATALOG_SUMMARY_SQL)
def q_catalog_summary(spark, d):
    return P.catalog_summary(q_profile_catalog(spark, d))


# --------------------------------------------------------------------- more cases of the same operators

QC_TOTALS_SQL = f"""
SELECT count(*) + 1 AS checks, count(*) FILTER (WHERE status = 'pass') AS passed, count(*) FILTER (WHERE status = 'fail') AS failed,
       CAST(1 AS BIGINT) AS errors, false AS gate_open FROM ({QC_ORDERS_SQL}) AS r
"""


@register("qc_totals", QC_TOTALS_SQL)
def q_qc_totals(spark, d):
    """Q5 with a check that cannot run: it counts as an error and closes the gate."""
    o = T(spark, d, "orders")
    broken = Q.run_checks(spark, [Q.Check("not_null_orders_o_gone", "orders", "not_null", "o_gone", lambda: Q.check_not_null(o, ["o_gone"], "orders"))])
    good = q_qc_orders(spark, d).select(*Q.CHECK_COLUMNS)
    return Q.qc_totals(Q.qc_report([good, broken]))


QC_SQL_CHECK_SQL = """
SELECT 'late_shipments' AS check_name, 'lineitem' AS table_name, 'custom' AS check_type, 'l_shipdate' AS field,
       count(*) AS failures, CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END AS status,
       CASE WHEN count(*) = 0 THEN 'ok' ELSE CAST(count(*) AS VARCHAR) || ' failing' END AS message
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_shipdate < o.o_orderdate
"""


@register("qc_sql_check", QC_SQL_CHECK_SQL)
def q_qc_sql_check(spark, d):
    """Q4 in its SQL form: a query for bad rows."""
    for t in ("orders", "lineitem"):
        row_view(spark, "qc", t, T(spark, d, t))
    sql = "SELECT * FROM row_qc_lineitem l JOIN row_qc_orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_shipdate < o.o_orderdate"
    return Q.qc_report([Q.check_custom_sql(spark, "late_shipments", sql, "lineitem", "l_shipdate")])


LENGTHS_SQL = """
SELECT 'length_part_std_' || f AS check_name, 'part_std' AS table_name, 'custom' AS check_type, f AS field, n AS failures
FROM (SELECT 'p_name' AS f, count(*) FILTER (WHERE length(p_name) > 12) AS n FROM part
      UNION ALL SELECT 'p_type', count(*) FILTER (WHERE length(p_type) > 5) FROM part)
"""


@register("check_lengths_part", LENGTHS_SQL)
def q_check_lengths_part(spark, d):
    std = Standard("part_std", (Field("p_name", "VARCHAR(12)"), Field("p_type", "CHAR(5) NOT NULL"), Field("p_size", "INTEGER")))
    return Q.check_lengths(T(spark, d, "part"), std)


CLEAN_TIMESTAMPS_SQL = """
SELECT event_id, CAST(ts AS DATE) AS day_of_timestamp, CAST(ts AS DATE) AS day_of_text,
       CASE WHEN event_type = 'error' THEN NULL ELSE CAST(ts AS DATE) END AS day_or_null FROM events
"""


@register("clean_timestamps", CLEAN_TIMESTAMPS_SQL)
def q_clean_timestamps(spark, d):
    """C6 on a timestamp column, on date-time text, and on text that is no date (made NULL on request)."""
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    src = T(spark, d, "events").select(
        "event_id",
        F.col("ts").alias("day_of_timestamp"),
        text.alias("day_of_text"),
        F.when(F.col("event_type") == "error", "no date").otherwise(text).alias("day_or_null"),
    )
    rules = [CleanRule(c, ("standardize_date",)) for c in ("day_of_timestamp", "day_of_text")]
    return apply_clean_rules(src, [*rules, CleanRule("day_or_null", ("standardize_date",), on_error="null")])


NUMERIC_TYPES_SQL = """
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(38,18)) AS price,
       CAST(o_custkey AS DOUBLE) AS customer, CAST(o_orderdate AS TIMESTAMP) AS placed FROM orders
"""


@register("numeric_types", NUMERIC_TYPES_SQL)
def q_numeric_types(spark, d):
    """Type names with digits and NUMERIC without precision keep all digits."""
    src = T(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price"),
        F.col("o_custkey").alias("customer"),
        F.col("o_orderdate").cast("string").alias("placed"),
    )
    types = {"o_orderkey": "INT8", "price": "numeric", "customer": "FLOAT8", "placed": "timestamp without time zone"}
    return apply_clean_rules(src, [CleanRule(c, ("cast_type",), t) for c, t in types.items()])


GAP_MERGE_SQL = """
SELECT c_custkey, c_name || '-' || c_mktsegment AS label, c_acctbal AS balance, n_name AS nation, CAST(NULL AS VARCHAR) AS email
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
"""


@register("gap_merge_customer", GAP_MERGE_SQL)
def q_gap_merge_customer(spark, d):
    """M9: a merge with a separator, a field in another letter case, a field of another table, a field nobody has."""
    gaps = [
        Mapping("label", "merge", sources=("c_name", "c_mktsegment"), merge_how="concat", separator="-"),
        Mapping("balance", "direct", "customer", "C_ACCTBAL"),
        Mapping("nation", "direct", "nation", "n_name"),
        Mapping("email", "direct", "customer", "c_email"),
    ]
    others = {"nation": M.SideTable(T(spark, d, "nation"), "c_nationkey", "n_nationkey")}
    return M.gap_fill(T(spark, d, "customer"), gaps, others=others).select("c_custkey", *[g.target for g in gaps])


HISTORY_ATTEMPTS_SQL = """
SELECT CAST(1 AS BIGINT) AS run_id, 'rows' AS kind, 'customer' AS item, count(*) AS value, 'profile' AS operation FROM customer
UNION ALL SELECT 1, 'rows', 'orders', count(*) FILTER (WHERE o_totalprice > 0), 'recount' FROM orders
UNION ALL SELECT 1, 'rows', 'nation', count(*), 'profile' FROM nation
"""


@register("history_attempts", HISTORY_ATTEMPTS_SQL)
def q_history_attempts(spark, d):
    """Two appends to one run add up; a rerun counts for its own items only."""
    import uuid

    path = shared_dir(spark, "history", uuid.uuid4().hex)

    def rows(name, df):
        return df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("item"), "value")

    o = T(spark, d, "orders")
    D.append_history(spark, path, rows("customer", T(spark, d, "customer")).unionByName(rows("orders", o)), 1, "rows", "profile")
    D.append_history(spark, path, rows("nation", T(spark, d, "nation")), 1, "rows", "profile")
    D.append_history(spark, path, rows("orders", o.where("o_totalprice > 0")), 1, "rows", "recount", "orders", "positive prices")
    return D.latest_attempts(spark.read.parquet(path)).select("run_id", "kind", "item", "value", "operation")


DELIVERY_TOTALS_SQL = """
SELECT CAST(3 AS BIGINT) AS tables, CAST(2 AS BIGINT) AS succeeded, CAST(1 AS BIGINT) AS failed,
       (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) AS total_rows, 'partial' AS status
"""


@register("delivery_totals", DELIVERY_TOTALS_SQL)
def q_delivery_totals(spark, d):
    """Totals of a delivery in which one table fails."""
    tables = {
        "clean_customer_t": T(spark, d, "customer"),
        "clean_orders_t": T(spark, d, "orders"),
        "clean_missing_t": "clean.no_such_table",
    }
    return D.delivery_summary(D.deliver(spark, tables, "replace", prod_db="prod"))


STANDARD_CSV_SQL = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, {k} AS table_order, {i} AS position, '{c}' AS field_name, '{kind.upper()}' AS data_type, "
    f"{str(i > 0).lower()} AS nullable, 'column {c} of ' || count(*) || ' rows' AS description, 'table {t}' AS table_description FROM {t}"
    for k, t in enumerate(("customer", "orders"))
    for i, (c, kind) in enumerate(STAR_SCHEMAS[t])
)


@register("standard_csv", STANDARD_CSV_SQL)
def q_standard_csv(spark, d):
    """A standard written as CSV from two tables' schemas and row counts, and read back."""
    import uuid

    from kiln.sources.standard_csv import read_standard_csv

    parts = []
    for t in ("customer", "orders"):
        n = T(spark, d, t).agg(F.count(F.lit(1)).cast("string").alias("n"))
        fields = [
            F.struct(
                F.lit(f" {f.name} ").alias("field_name"),
                F.lit(f.dataType.simpleString().upper() + ("" if i else " not  null")).alias("field_type"),
                F.concat(F.lit(f"column {f.name} of "), F.col("n"), F.lit(" rows")).alias("field_comment"),
            )
            for i, f in enumerate(T(spark, d, t).schema.fields)
        ]
        head = [F.lit("demo").alias("module"), F.lit(t).alias("table_name"), F.lit(f"table {t}").alias("table_comment")]
        parts.append(n.select(*head, F.inline(F.array(*fields))).withColumn("example", F.lit("")))
    path = shared_dir(spark, "standard", uuid.uuid4().hex)
    # a standard is one small file in reading order: a row per field
    parts[0].unionByName(parts[1]).coalesce(1).write.option("header", True).csv(path)
    return read_standard_csv(spark, path)


PII_CONTACT_TURNS_SQL = f"""
WITH src AS (SELECT conv_id, turn, text || ' u' || conv_id || '@example.com 138' || lpad(CAST(conv_id AS VARCHAR), 8, '0') AS text FROM conversations),
tok AS (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+')) AS token FROM src),
lab AS (SELECT conv_id, turn, {pii_labels_sql('token', 'false')} AS labels FROM tok WHERE regexp_matches(token, '[0-9@一-鿿]')),
x AS (SELECT conv_id, turn, unnest(string_split(labels, ',')) AS label FROM lab WHERE labels <> '')
SELECT conv_id, turn, label, count(*) AS tokens FROM x GROUP BY ALL
"""


@register("pii_contact_turns", PII_CONTACT_TURNS_SQL)
def q_pii_contact_turns(spark, d):
    """Conversations whose turns end with an e-mail address and a mobile number made from their id."""
    key = F.col("conv_id").cast("string")
    contact = F.concat(F.lit("u"), key, F.lit("@example.com 138"), F.lpad(key, 8, "0"))
    turns = T(spark, d, "conversations").withColumn("text", F.concat_ws(" ", "text", contact))
    return I.pii_tokens(turns, "text", keep=["conv_id", "turn"])


# --------------------------------------------------------------------- publishing, fan-out, gaps, evidence

from kiln.operators.standard import JoinEvidence, readiness_report  # noqa: E402

ODS_FAILED_REFRESH_SQL = """
SELECT 'customer' AS table_name, 'success' AS status, count(*) AS readable_rows, CAST(sum(c_custkey) AS BIGINT) AS key_sum
FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT 'orders', 'failed', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders
UNION ALL SELECT 'copy of orders', 'failed', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders
"""


@register("ods_failed_refresh", ODS_FAILED_REFRESH_SQL)
def q_ods_failed_refresh(spark, d):
    """A second refresh of which one table and its copy fail; the old rows stay readable."""
    from kiln.sources.ods import bulk_copy

    customer, orders = T(spark, d, "customer"), T(spark, d, "orders")
    sync_to_ods(spark, "tpch_refresh", {"customer": customer, "orders": orders})
    path = shared_dir(spark, "copy_target", "orders_refresh")
    bulk_copy(orders, {"path": path})
    broken = orders.withColumn("o_orderkey", F.when(F.col("o_orderkey") > 3, F.raise_error(F.lit("source lost"))).otherwise(F.col("o_orderkey")))
    res = sync_to_ods(spark, "tpch_refresh", {"customer": customer.where("c_custkey % 2 = 0"), "orders": broken})
    try:
        bulk_copy(broken, {"path": path})
        copied = "success"
    except Exception:  # what the query shows
        copied = "failed"
    status = {r.table_name: r.status for r in res.collect()} | {"copy of orders": copied}
    frames = {
        "customer": (spark.table("ods_tpch_refresh.customer"), "c_custkey"),
        "orders": (spark.table("ods_tpch_refresh.orders"), "o_orderkey"),
        "copy of orders": (spark.read.parquet(path), "o_orderkey"),
    }
    out = None
    for name, (df, key) in frames.items():
        row = df.agg(F.count(F.lit(1)).alias("readable_rows"), F.sum(key).alias("key_sum"))
        row = row.select(F.lit(name).alias("table_name"), F.lit(status[name]).alias("status"), "readable_rows", "key_sum")
        out = row if out is None else out.unionByName(row)
    return out


DELIVER_AUTO_SQL = """
SELECT 'prod' AS target, 'atomic' AS strategy, 'success' AS status, count(*) AS "rows" FROM supplier
UNION ALL SELECT 'folder', 'copy', 'success', count(*) FROM supplier
UNION ALL SELECT 'prod, planned', 'atomic', 'planned', NULL
"""


@register("deliver_auto", DELIVER_AUTO_SQL)
def q_deliver_auto(spark, d):
    """The target decides between the atomic switch and a copy."""
    tables = {"clean_supplier_auto": T(spark, d, "supplier")}
    folder = {"format": "parquet", "path": shared_dir(spark, "copy_auto")}
    runs = {
        "prod": D.deliver(spark, tables),
        "folder": D.deliver(spark, tables, target=folder),
        "prod, planned": D.deliver(spark, tables, dry_run=True),
    }
    out = None
    for name, res in runs.items():
        row = res.select(F.lit(name).alias("target"), "strategy", "status", "rows")
        out = row if out is None else out.unionByName(row)
    return out


FANOUT_FORECAST_SQL = """
WITH j AS (
  SELECT 'orders to lineitem' AS plan, o.o_orderkey AS k, (SELECT count(*) FROM orders) AS base_rows
  FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey
  UNION ALL
  SELECT 'customer to orders, left', c_custkey, (SELECT count(*) FROM customer) FROM customer LEFT JOIN orders ON c_custkey = o_custkey
  UNION ALL
  SELECT 'events to itself', a.user_id, (SELECT count(*) FROM events) FROM events a JOIN events b ON a.user_id = b.user_id),
n AS (SELECT plan, k, base_rows, count(*) AS n FROM j GROUP BY ALL)
SELECT plan, base_rows, CAST(sum(n) AS BIGINT) AS joined_rows, count(*) FILTER (WHERE n > 1) AS repeated_keys,
       max(n) AS max_rows_per_key, sum(n) > base_rows AS inflated
FROM n GROUP BY plan, base_rows
"""


@register("fanout_forecast", FANOUT_FORECAST_SQL)
def q_fanout_forecast(spark, d):
    """The rows of three joins, predicted; the oracle makes the joins."""
    orders, events = T(spark, d, "orders"), T(spark, d, "events")
    a = M.fanout_forecast(orders, T(spark, d, "lineitem"), "o_orderkey", "l_orderkey")
    b = M.fanout_forecast(T(spark, d, "customer"), orders, "c_custkey", "o_custkey", "left")
    c = M.fanout_forecast(events, events, "user_id")
    plans = {"orders to lineitem": a, "customer to orders, left": b, "events to itself": c}
    frames = [df.select(F.lit(name).alias("plan"), "*") for name, df in plans.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


FANOUT_KEYS_SQL = """
WITH a AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_suppkey, n AS base_rows, n AS side_rows, n * n AS joined_rows FROM a WHERE n > 1 ORDER BY n * n DESC, l_suppkey LIMIT 20
"""


@register("fanout_keys_lineitem", FANOUT_KEYS_SQL)
def q_fanout_keys(spark, d):
    """The keys that a join of lineitem with itself by supplier would multiply most (a top-k report)."""
    li = T(spark, d, "lineitem")
    return M.fanout_keys(li, li, "l_suppkey", k=20)


GAP_EXPRESSIONS_SQL = """
WITH o AS (SELECT o_custkey, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS spent FROM orders GROUP BY 1)
SELECT c_custkey, upper(n_name) || '/' || c_mktsegment AS place, CAST(coalesce(o.n, 0) AS BIGINT) AS orders,
       coalesce(o.spent, 0) > 1000000 AS big, concat_ws('-', c_name, n_name, r_name) AS label, r_name AS region
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN o ON o_custkey = c_custkey
"""


@register("gap_fill_expressions", GAP_EXPRESSIONS_SQL)
def q_gap_fill_expressions(spark, d):
    """M9: expressions and merges over new tables, each of which is found and joined once."""
    spent = T(spark, d, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("spent")
    )
    nation = T(spark, d, "nation").join(T(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    others = {"nation": M.SideTable(nation, "c_nationkey", "n_nationkey"), "spent": M.SideTable(spent, "c_custkey", "o_custkey")}
    gaps = [
        Mapping("place", "transform", "nation", expr="upper(n_name) || '/' || c_mktsegment"),
        Mapping("orders", "transform", "spent", expr="coalesce(spent.n, 0)"),
        Mapping("big", "transform", "spent", expr="coalesce(spent.spent, 0) > 1000000"),
        Mapping("label", "merge", "nation", sources=("c_name", "n_name", "r_name"), merge_how="concat", separator="-"),
        Mapping("region", "direct", "nation", "r_name"),
    ]
    return M.gap_fill(T(spark, d, "customer"), gaps, others=others).select("c_custkey", *[g.target for g in gaps])


EVIDENCE_TARGET = Standard(
    "dim_party", (Field("id", "BIGINT", False), Field("nation", "VARCHAR(25)", False), Field("orders", "BIGINT"), Field("email", "TEXT"))
)
NO_SOURCE_TARGET = Standard("dim_branch", (Field("id", "BIGINT", False), Field("city", "TEXT")))
EVIDENCE_SQL = f"""
WITH m AS (
  SELECT c_custkey AS id, coalesce(n_name, 'unknown') AS nation, n_nationkey IS NOT NULL AS has_nation, coalesce(n, 0) AS orders, n IS NOT NULL AS has_orders
  FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 2) ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey),
s AS (SELECT {ratio4_sql('count(*) FILTER (WHERE has_nation)', 'count(*)')} AS a, {ratio4_sql('count(*) FILTER (WHERE has_orders)', 'count(*)')} AS b FROM m),
c AS (SELECT CAST(round((1 + a + b) * 10000) AS BIGINT) AS units FROM s)
SELECT 'dim_party' AS table_name, 4 AS fields, 1 AS uncovered, {ratio4_sql('units', '40000')} AS confidence,
       CASE WHEN {ratio4_sql('units', '40000')} >= 0.7 THEN 'suggest' ELSE 'manual' END AS recommendation, 'low' AS risk FROM c
UNION ALL SELECT 'dim_branch', 2, 2, 0.0, 'manual', 'high'
"""


@register("readiness_evidence", EVIDENCE_SQL)
def q_readiness_evidence(spark, d):
    """Two joins that do not always match, filled with defaults, and a target that has no source."""
    nation = T(spark, d, "nation").where("n_regionkey < 2")
    counts = T(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    model = M.enrich(T(spark, d, "customer"), nation, "c_nationkey", "n_nationkey", ["n_name"], matched="has_nation")
    model = M.enrich(model, counts, "c_custkey", "o_custkey", ["n"], matched="has_orders")
    model = model.select(
        F.col("c_custkey").alias("id"), F.coalesce("n_name", F.lit("unknown")).alias("nation"), F.coalesce("n", F.lit(0)).alias("orders"),
        "has_nation", "has_orders",
    )
    joins = [JoinEvidence("nation", "has_nation", ("nation",)), JoinEvidence("orders", "has_orders", ("orders",))]
    return readiness_report(coverage_audit(model, EVIDENCE_TARGET, joins), [EVIDENCE_TARGET, NO_SOURCE_TARGET])


# --------------------------------------------------------------------- top values and samples without a value shuffle

from kiln.operators import frequent as FQ  # noqa: E402

FREQUENT_COLS = ["l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate", "l_quantity", "l_suppkey", "l_orderkey"]
FREQUENT_SRC = (
    "(SELECT l_linenumber, l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate, "
    "CAST(l_quantity AS DECIMAL(18,2)) AS l_quantity, l_suppkey, l_orderkey FROM lineitem) AS s"
)
FREQUENT_SQL = f"""
WITH vc AS (SELECT column_name, value, count(*) AS cnt FROM ({_long_sql(FREQUENT_COLS, FREQUENT_SRC)}) lv GROUP BY column_name, value),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value ASC NULLS LAST) AS rnk,
             sum(cnt) OVER (PARTITION BY column_name) AS n FROM vc)
SELECT 'lineitem' AS table_name, column_name, CAST(rnk AS INTEGER) AS rank, value, cnt AS "count",
       {ratio4_sql('cnt', 'n')} AS frequency
FROM r WHERE rnk <= 5
"""


@register("frequent_values_lineitem", FREQUENT_SQL)
def q_frequent_values(spark, d):
    """Top values proven by a sketch and an exact recount, in full only where that proves nothing."""
    return FQ.frequent_values(decimal_doubles(T(spark, d, "lineitem")), 5, "lineitem", FREQUENT_COLS)


DISTINCT_SAMPLE_SQL = f"""
WITH vc AS (SELECT DISTINCT column_name, value FROM ({_long_sql(FREQUENT_COLS, FREQUENT_SRC)}) lv WHERE value IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY md5(value), value) AS rnk FROM vc)
SELECT 'lineitem' AS table_name, column_name, CAST(rnk AS INTEGER) AS rank, value FROM r WHERE rnk <= 8
"""


@register("distinct_sample_lineitem", DISTINCT_SAMPLE_SQL)
def q_distinct_sample(spark, d):
    """Eight distinct values of each column by the smallest hashes."""
    return FQ.distinct_sample(decimal_doubles(T(spark, d, "lineitem")), 8, "lineitem", FREQUENT_COLS)


# --------------------------------------------------------------------- kept profiles

from kiln.operators import profile_state as PS  # noqa: E402

STATE_COLS = [("l_orderkey", "l_orderkey"), ("l_suppkey", "l_suppkey"), ("l_quantity", "CAST(l_quantity AS DECIMAL(18,2))"),
              ("l_returnflag", "l_returnflag"), ("l_shipdate", "strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')")]
PROFILE_STATE_SQL = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, CAST(min({e}) AS VARCHAR) AS min_value, "
    f"CAST(max({e}) AS VARCHAR) AS max_value, true AS distinct_within_error FROM lineitem"
    for c, e in STATE_COLS
)


@register("profile_state_lineitem", PROFILE_STATE_SQL)
def q_profile_state(spark, d):
    """The profile of lineitem from the states of its ship years, kept in two updates and merged."""
    import uuid

    table = decimal_doubles(T(spark, d, "lineitem")).select(*[c for c, _ in STATE_COLS])
    path = shared_dir(spark, "profile_state", uuid.uuid4().hex)
    years = [r.y for r in table.select(F.year("l_shipdate").cast("string").alias("y")).distinct().orderBy("y").collect()]  # few
    read = lambda parts: table.withColumn("part", F.year("l_shipdate")).where(F.col("part").isin([int(p) for p in parts]))
    PS.update_states(spark, path, years[: len(years) // 2], read)
    PS.update_states(spark, path, years, read)
    merged = PS.merged_profile(spark.read.parquet(path), table)
    exact = P.unique_count(table).select("column_name", F.col("unique_count").alias("exact"))
    within = F.abs(F.col("unique_count") - F.col("exact")) <= 3 * PS.SKETCH_ERROR * F.col("exact")
    return merged.join(exact, "column_name").select(
        "column_name", "row_count", "null_count", "min_value", "max_value", within.alias("distinct_within_error")
    )
