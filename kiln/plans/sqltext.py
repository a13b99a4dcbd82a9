"""SQL text for the DuckDB oracle: the same meaning written independently as ANSI SQL."""

from __future__ import annotations


def ratio4_sql(num: str, den: str) -> str:
    """Half-up rounding of num/den to 4 places; mirrors ``kiln.functions.common.ratio4``."""
    return (
        f"(CASE WHEN ({den}) > 0 THEN CAST((CAST({num} AS BIGINT) * 20000 + ({den})) // (2 * ({den})) AS DOUBLE) / 10000 "
        f"ELSE 0.0 END)"
    )


def profile_sql(table: str, columns: list[tuple[str, str, str]], source: str) -> str:
    """Column stats as a UNION ALL, one SELECT per column.

    ``columns``: (name, spark type name, SQL expression over ``source``).
    """
    inner = f"(SELECT {', '.join(f'{expr} AS {name}' for name, _, expr in columns)} FROM {source}) AS t"
    parts = []
    for pos, (name, dtype, _) in enumerate(columns):
        nulls = f"(count(*) - count({name}))"
        if dtype.startswith("array"):  # counts only
            parts.append(
                f"SELECT '{table}' AS table_name, {pos} AS position, '{name}' AS column_name, '{dtype}' AS data_type, "
                f"count(*) AS row_count, {nulls} AS null_count, {ratio4_sql(nulls, 'count(*)')} AS null_rate, "
                "CAST(NULL AS BIGINT) AS unique_count, false AS is_unique_candidate, "
                f"CAST(NULL AS VARCHAR) AS min_value, CAST(NULL AS VARCHAR) AS max_value FROM {inner}"
            )
            continue
        parts.append(
            f"SELECT '{table}' AS table_name, {pos} AS position, '{name}' AS column_name, '{dtype}' AS data_type, "
            f"count(*) AS row_count, {nulls} AS null_count, {ratio4_sql(nulls, 'count(*)')} AS null_rate, "
            f"count(DISTINCT {name}) AS unique_count, "
            f"(count(DISTINCT {name}) = count(*) AND count(*) > 0) AS is_unique_candidate, "
            f"CAST(min({name}) AS VARCHAR) AS min_value, CAST(max({name}) AS VARCHAR) AS max_value FROM {inner}"
        )
    return "\nUNION ALL\n".join(parts)


def long_values_sql(columns: list[tuple[str, str]], source: str) -> str:
    """(column_name, value) rows, one UNION ALL branch per column; (name, SQL expression)."""
    return "\nUNION ALL\n".join(
        f"SELECT '{name}' AS column_name, CAST({expr} AS VARCHAR) AS value FROM {source}" for name, expr in columns
    )


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip_sql(v: str) -> str:
    from kiln.functions.common import WS_CLASS

    return f"regexp_replace({v}, {_q(f'^{WS_CLASS}+|{WS_CLASS}+$')}, '', 'g')"


# The rules on personal data are written out here a second time, so that a wrong pattern or word in
# kiln.functions.pii or kiln.plans.names shows as a difference. Only the text of surnames is shared.
_VALUE_RULES = (
    ("china_mobile", "^1[3-9][0-9]{9}$"),
    ("phone", r"^(\+[0-9]{1,4}[-\s]?)?[0-9]{7,15}$"),
    ("email", r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"),
    ("china_idcard", "^([0-9]{15}|[0-9]{17}[0-9Xx])$"),
    ("bank_card", "^[0-9]{16,19}$"),
    ("passport", "^([A-Z][0-9]{7,9}|[0-9]{9})$"),
    ("ipv4", r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"),
)
_ADDRESS = "省|自治区|直辖市|市|地区|自治州|盟|县|自治县|区|市辖区|旗|自治旗|林区|乡|镇|街道|路|街|巷|号|栋|单元|室|层|楼"
_DATE = "^([0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4})$"
_NAME_RULES = (
    ("chinese_name", "name|姓名|联系人|负责人|患者姓名", "username,groupname,filename,classname,tablename,columnname,dbname"),
    ("birth_date", "dob|birth|birthday|出生日期|生日|出生年月|出生时间", ""),
    ("address", "address|addr|地址|住址|居住地|户籍|籍贯", ""),
    ("phone", "phone|mobile|tel|电话|手机|手机号|联系方式|联系电话", ""),
    ("email", "email|mail|邮箱|邮件|电子邮箱|电邮", ""),
    ("china_idcard", "idcard|身份证|身份证号|证件号|居民身份证", ""),
)


def key_hint_sql(name: str) -> str:
    return f"regexp_matches('{name.lower()}', 'id|no|code|seq|num|sn|编号|序号')"


def name_types_sql(name: str) -> str:
    """Comma-joined types a column name suggests."""
    bare = f"lower(replace('{name}', '_', ''))"
    picks = [
        f"CASE WHEN regexp_matches({bare}, '^({words})|({words})$') AND NOT list_contains(string_split('{excluded}', ','), {bare}) THEN '{kind}' END"
        for kind, words, excluded in _NAME_RULES
    ]
    return f"concat_ws(',', {', '.join(picks)})"


def sensitive_name_sql(name: str) -> str:
    x = f"('_' || lower(regexp_replace(regexp_replace('{name}', '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[-\\s]+', '_', 'g')) || '_')"
    words = "phone|tel|mobile|email|mail|card|identity|address|addr|password|passwd|pwd|ssn|social|bank|account"
    return (
        f"(regexp_matches({x}, '_({words})_') OR (regexp_matches({x}, '_name_') "
        f"AND NOT regexp_matches({x}, '_(group|type|class|schema|table|user)_name_')) "
        f"OR regexp_matches({x}, '姓名|电话|手机|邮箱|身份证|地址|住址|密码|卡号|账号'))"
    )


def mask_kind_sql(name: str, types: str) -> str:
    """Which mask a flagged column takes, from its types (an SQL expression) and its name."""
    low = name.lower()
    has = lambda t: f"list_contains(string_split({types}, ','), '{t}')"
    named = (
        f"(('{low}' = 'name' OR ends_with('{low}', '_name') OR starts_with('{low}', 'name_') OR contains('{low}', '姓名')) "
        f"AND NOT contains('{low}', 'user') AND NOT contains('{low}', 'group'))"
    )
    return (
        f"(CASE WHEN {has('chinese_name')} OR {named} THEN 'name' "
        f"WHEN {has('address')} OR regexp_matches('{low}', 'address|addr|地址|住址') THEN 'address' "
        f"WHEN {has('birth_date')} OR regexp_matches('{low}', 'dob|birth|出生日期|生日') THEN 'birth_date' ELSE 'default' END)"
    )


def pii_labels_sql(v: str, key_hint: str = "false") -> str:
    """Comma-joined PII labels of a value."""
    from kiln.functions.pii import CHINESE_NAME

    s = strip_sql(f"CAST({v} AS VARCHAR)")
    digits = f"regexp_replace({s}, '[^0-9]', '', 'g')"
    nd = f"length({digits})"
    phone_ok = f"({nd} BETWEEN 7 AND 15 AND NOT ({nd} = 8 AND starts_with({digits}, '20')))"
    parts = []
    for label, pat in (*_VALUE_RULES, ("chinese_name", CHINESE_NAME)):
        cond = f"regexp_matches({s}, {_q(pat)})"
        if label in ("china_mobile", "phone"):
            cond += f" AND {phone_ok}"
        parts.append(f"CASE WHEN {cond} THEN '{label}' END")
    addr = f"regexp_matches({s}, {_q(_ADDRESS)}) AND length({s}) >= 6 AND NOT regexp_matches({s}, {_q(_DATE)})"
    parts.append(f"CASE WHEN {addr} THEN 'address' END")
    key = (
        f"(regexp_matches({s}, '^[0-9]+$') AND (length(ltrim({s}, '0')) <= 6 OR {key_hint}))"
    )
    return (
        f"(CASE WHEN {s} IS NULL OR length({s}) < 2 OR coalesce({key}, false) THEN '' "
        f"ELSE concat_ws(',', {', '.join(parts)}) END)"
    )


def mask_default_sql(v: str) -> str:
    n = f"length({v})"
    return (
        f"(CASE WHEN {v} IS NULL THEN NULL WHEN {n} <= 1 THEN '*' "
        f"WHEN {n} <= 6 THEN substr({v}, 1, 1) || repeat('*', greatest({n} - 2, 0)) || substr({v}, {n}, 1) "
        f"ELSE substr({v}, 1, 2) || repeat('*', {n} - 4) || substr({v}, {n} - 1, 2) END)"
    )


def mask_name_sql(v: str) -> str:
    n = f"length({v})"
    return f"(CASE WHEN {v} IS NULL THEN NULL WHEN {n} <= 1 THEN '*' ELSE substr({v}, 1, 1) || repeat('*', {n} - 1) END)"


def mask_birth_sql(v: str) -> str:
    dash = "^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"
    slash = "^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$"
    return (
        f"(CASE WHEN {v} IS NULL THEN NULL WHEN length({v}) <= 1 THEN '*' "
        f"WHEN regexp_matches({v}, '{dash}') THEN substr({v}, 1, 4) || '-**-**' "
        f"WHEN regexp_matches({v}, '{slash}') THEN substr({v}, 1, 4) || '/**/**' "
        f"ELSE {mask_default_sql(v)} END)"
    )


def mask_address_sql(v: str) -> str:
    from kiln.functions.pii import DIVISION_STOP_CHARS, DIVISION_WORDS

    head = f"regexp_extract({v}, '^(.*[^{DIVISION_STOP_CHARS}\\s](?:{DIVISION_WORDS}))', 1)"
    n = f"length({v})"
    return (
        f"(CASE WHEN {v} IS NULL THEN NULL WHEN {n} <= 1 THEN '*' "
        f"WHEN length({head}) = 0 THEN (CASE WHEN {n} <= 4 THEN substr({v}, 1, 1) || repeat('*', {n} - 1) "
        f"ELSE substr({v}, 1, 2) || repeat('*', {n} - 2) END) "
        f"WHEN length({head}) >= {n} - 1 THEN {v} "
        f"ELSE {head} || repeat('*', greatest(4, {n} - length({head}))) END)"
    )


def scan_sql(table: str, columns: list[tuple[str, str]], source: str, threshold: float = 0.3) -> str:
    """PII scan of one table as SQL: one row per column (table_name, column_name, detected_by,
    samples, pii_ratio, pii_types, sensitive_name, mask_kind); mirrors ``kiln.operators.pii.pii_scan``."""
    order = "['china_mobile','phone','email','china_idcard','bank_card','passport','ipv4','chinese_name','address']"
    meta = ", ".join(f"({i}, '{c}', {name_types_sql(c)}, {sensitive_name_sql(c)})" for i, (c, _) in enumerate(columns))
    long = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, {pii_labels_sql(expr, key_hint_sql(c))} AS labels "
        f"FROM {source} WHERE {expr} IS NOT NULL"
        for c, expr in columns
    )
    kinds = [f"WHEN column_name = '{c}' THEN {mask_kind_sql(c, 'types')}" for c, _ in columns]
    return f"""
(WITH names(position, column_name, name_types, sensitive_name) AS (VALUES {meta}),
v AS ({long}),
per_col AS (SELECT column_name, count(*) AS samples, count(*) FILTER (WHERE labels <> '') AS hits FROM v GROUP BY column_name),
lab AS (SELECT column_name, unnest(string_split(labels, ',')) AS label FROM v WHERE labels <> ''),
lc AS (SELECT column_name, label, count(*) AS n FROM lab GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, list_position({order}, label)) AS r FROM lc),
top AS (SELECT column_name, string_agg(label, ',' ORDER BY r) AS value_types FROM rk WHERE r <= 3 GROUP BY column_name),
j AS (SELECT m.*, coalesce(p.samples, 0) AS samples, coalesce(p.hits, 0) AS hits, t.value_types,
             {ratio4_sql('coalesce(p.hits, 0)', 'coalesce(p.samples, 0)')} AS ratio
      FROM names m LEFT JOIN per_col p USING (column_name) LEFT JOIN top t USING (column_name)),
d AS (SELECT *, CASE WHEN name_types <> '' THEN 'name' WHEN hits > 0 AND ratio >= {threshold} THEN 'value' ELSE 'none' END AS detected_by,
             CASE WHEN name_types <> '' THEN name_types WHEN hits > 0 AND ratio >= {threshold} THEN value_types ELSE '' END AS types
      FROM j)
SELECT '{table}' AS table_name, column_name, detected_by, CAST(samples AS BIGINT) AS samples, ratio AS pii_ratio, types AS pii_types,
       sensitive_name, CASE {' '.join(kinds)} END AS mask_kind
FROM d)"""
