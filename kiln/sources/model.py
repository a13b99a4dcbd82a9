"""Whole-table SQL models (S7) with named inputs, and table writes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_SOURCE_REF = re.compile(r"\{\{\s*source\(\s*'([^']+)'\s*,\s*'([^']+)'\s*\)\s*\}\}")
_MODEL_REF = re.compile(r"\{\{\s*ref\(\s*'([^']+)'\s*\)\s*\}\}")


def model_inputs(sql: str) -> list[tuple[str, str]]:
    """``(source, table)`` pairs named by ``{{ source('s', 't') }}`` in a model."""
    return sorted(set(_SOURCE_REF.findall(sql)))


def resolve_input(spark: SparkSession, source: str, table: str) -> DataFrame | None:
    """Find a model input in the catalog: attached view, then synced staging table, then any database."""
    from kiln.sources.tables import view_name

    attached = view_name("src", source, table)
    if spark.catalog.tableExists(attached):
        return spark.table(attached)
    synced = f"ods_{re.sub(r'[^0-9a-z_]', '_', source.lower())}.{table.lower()}"
    if spark.catalog.tableExists(synced):
        return spark.table(synced)
    for db in spark.catalog.listDatabases():
        if spark.catalog.tableExists(f"{db.name}.{table}"):
            return spark.table(f"{db.name}.{table}")
    return None


def run_model(
    spark: SparkSession,
    sql: str,
    inputs: dict[tuple[str, str] | str, DataFrame] | None = None,
    args: dict | None = None,
) -> DataFrame:
    """Run a SQL model whose inputs are named, not physical.

    ``{{ source('s','t') }}`` looks up ``inputs[('s','t')]``, then ``inputs['t']``,
    then the catalog in the order attached (federated) -> synced -> any
    database; ``{{ ref('m') }}`` looks up ``inputs['m']``. Every input is bound as a
    DataFrame argument, so the model inlines into one plan with its inputs and
    Catalyst prunes and pushes filters into their scans. Unresolved inputs
    raise with the full missing list.
    """
    inputs = inputs or {}
    bound: dict[str, DataFrame] = {}
    missing: list[str] = []

    def bind(key, label):
        df = inputs.get(key)
        if df is None and isinstance(key, tuple):
            df = inputs.get(key[1])
        if df is None and isinstance(key, tuple):
            df = resolve_input(spark, key[0], key[1])
        if df is None:
            missing.append(label)
            return "__missing__"
        name = "in_" + re.sub(r"[^0-9a-zA-Z_]", "_", "_".join(key) if isinstance(key, tuple) else key)
        bound[name] = df
        return "{" + name + "}"

    text = _SOURCE_REF.sub(lambda m: bind((m.group(1), m.group(2)), f"{m.group(1)}.{m.group(2)}"), sql)
    text = _MODEL_REF.sub(lambda m: bind(m.group(1), m.group(1)), text)
    if missing:
        raise LookupError(f"model inputs not found: {sorted(set(missing))}")
    return spark.sql(text, args=args, **bound)
