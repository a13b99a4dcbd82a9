"""The flagship model: customers conformed to a 10-field standard.

customer -> nation -> region (M6), orders pre-aggregated per customer (M7),
direct / transform / missing fields (M1, M2, M4), clean rules (C1, C2, C3, C5),
conformed to the standard (T3).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.operators.cleaning import apply_clean_rules
from kiln.operators.mapping import build_map, enrich, preaggregate_join
from kiln.operators.standard import conform
from kiln.plans.spec import CleanRule, Field, Mapping, Standard

CUSTOMER_360 = Standard(
    "dim_customer",
    (
        Field("customer_id", "BIGINT", False, "customer key", ("unique",)),
        Field("customer_name", "VARCHAR(25)", False, "display name"),
        Field("nation_name", "VARCHAR(25)", True, "nation"),
        Field("region_name", "VARCHAR(25)", True, "region"),
        Field("market_segment", "VARCHAR(10)", False, "segment, lower case"),
        Field("account_balance", "DECIMAL(15,2)", True, "balance"),
        Field("order_count", "BIGINT", False, "orders placed"),
        Field("total_spend", "DECIMAL(18,2)", False, "sum of order totals"),
        Field("last_order_date", "DATE", True, "latest order"),
        Field("email", "VARCHAR(100)", True, "no source: missing"),
    ),
    "one row per customer",
)

CUSTOMER_360_MAPPINGS = (
    Mapping("customer_id", "direct", "customer", "c_custkey"),
    Mapping("customer_name", "direct", "customer", "c_name"),
    Mapping("nation_name", "direct", "nation", "n_name"),
    Mapping("region_name", "direct", "region", "r_name"),
    Mapping("market_segment", "direct", "customer", "c_mktsegment"),
    Mapping("account_balance", "transform", "customer", "c_acctbal", "CAST(c_acctbal AS DECIMAL(15,2))"),
    Mapping("order_count", "direct", "orders", "order_count"),
    Mapping("total_spend", "direct", "orders", "total_spend"),
    Mapping("last_order_date", "transform", "orders", "last_order_ts", "CAST(last_order_ts AS DATE)"),
    Mapping("email", "missing"),
)

CUSTOMER_360_RULES = (
    CleanRule("customer_name", ("trim_whitespace", "uppercase")),
    CleanRule("market_segment", ("trim_whitespace", "lowercase", "coalesce_null"), default="unknown"),
)


def customer_360(customer: DataFrame, nation: DataFrame, region: DataFrame, orders: DataFrame) -> DataFrame:
    geo = enrich(customer, nation, "c_nationkey", "n_nationkey", ["n_name", "n_regionkey"])
    geo = enrich(geo, region, "n_regionkey", "r_regionkey", ["r_name"])
    spend = preaggregate_join(
        geo,
        orders,
        "c_custkey",
        "o_custkey",
        {
            "order_count": F.count(F.lit(1)),
            "total_spend": F.sum(F.col("o_totalprice").cast("decimal(18,2)")),
            "last_order_ts": F.max("o_orderdate"),
        },
        zero_fill=("order_count", "total_spend"),
    )
    mapped = build_map(spend, CUSTOMER_360_MAPPINGS, CUSTOMER_360)
    cleaned = apply_clean_rules(mapped, CUSTOMER_360_RULES, standard=CUSTOMER_360)
    return conform(cleaned, CUSTOMER_360)
