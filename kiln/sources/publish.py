"""Publishing by commit pointer.

Every write goes to an attempt of its own; when it is complete, one pointer is switched to it, and readers see the old rows
until then and the new ones afterwards. A write that fails leaves its attempt behind and the pointer where it was.

The pointer is a view's definition, a table's location, the name of a folder, or the name of a table in another database.
What has been published is read from the pointer itself: its definition names the current version, a property of it the version
before. The version before is kept for one cycle, so that a reader of it can finish, and goes with the next
publication. Attempts that no pointer names were left by a writer that died; they go once they are older than a grace period, which
protects a writer that is still busy.
"""

from __future__ import annotations

import logging
import re
import time
import uuid

from pyspark.sql import SparkSession

from kiln.sources.attach import _hadoop, list_folder, remove_folder

log = logging.getLogger(__name__)

#: Seconds after which an attempt that no pointer names counts as left behind.
GRACE = 3600.0
PREVIOUS = "kiln.previous"


def new_attempt(name: str) -> str:
    """A name for an attempt to write ``name``: unique, and sorted by time."""
    return f"{name.lower()}__v{time.time_ns() // 1_000_000:014d}_{uuid.uuid4().hex[:6]}"


def attempt_pattern(name: str) -> str:
    return rf"{re.escape(name.lower())}__[vr](\d{{14}})_[0-9a-f]{{6}}"


def left_behind(name: str, found: list[str], keep: set[str], grace: float = GRACE) -> list[str]:
    """Those of the attempts ``found`` that are none of ``keep`` and older than the grace period."""
    limit = (time.time() - grace) * 1000
    old = [(f, re.fullmatch(attempt_pattern(name), f)) for f in found if f not in keep]
    return sorted(f for f, m in old if m and int(m[1]) <= limit)


def pointer_kind(spark: SparkSession, db: str, name: str) -> str | None:
    """``TABLE``, ``VIEW`` or None."""
    if not spark.catalog.tableExists(f"{db}.{name}"):
        return None
    return "VIEW" if spark.catalog.getTable(f"{db}.{name}").tableType == "VIEW" else "TABLE"


def pointer_target(spark: SparkSession, db: str, name: str) -> str | None:
    """The version that a view's or table's definition names: a table, or the last part of a location."""
    rows = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {db}.{name}").collect()}  # bounded by the columns
    if "View Text" in rows:
        m = re.search(r"FROM\s+(?:\S+\.)?(\S+)\s*$", rows["View Text"])
        return m[1].strip("`") if m else None
    return rows["Location"].rstrip("/").rpartition("/")[2] if "Location" in rows else None


def pointer_previous(spark: SparkSession, db: str, name: str) -> str | None:
    """The version published before the current one, from the pointer's own properties."""
    rows = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {db}.{name}").collect()}
    return rows.get(PREVIOUS) or None


def switch_view(spark: SparkSession, db: str, name: str, version: str, grace: float = GRACE) -> None:
    """Point the view ``db.name`` at the table ``db.version`` in one catalog operation and drop what it has no use for.

    A table of that name is dropped first, once; readers may miss it for that moment.
    """
    kind = pointer_kind(spark, db, name)
    current = pointer_target(spark, db, name) if kind == "VIEW" else None
    outdated = pointer_previous(spark, db, name) if kind == "VIEW" else None
    if kind == "TABLE":
        spark.sql(f"DROP TABLE {db}.{name}")
    spark.sql(f"CREATE OR REPLACE VIEW {db}.{name} TBLPROPERTIES ('{PREVIOUS}' = '{current or ''}') AS SELECT * FROM {db}.{version}")
    keep = {version, current}
    found = [t.name for t in spark.catalog.listTables(db, f"{name.lower()}__*")]
    for t in {*left_behind(name, found, keep, grace), *([outdated] if outdated and outdated not in keep else [])}:
        if re.fullmatch(attempt_pattern(name), t):
            spark.sql(f"DROP TABLE IF EXISTS {db}.{t}")


def switch_location(
    spark: SparkSession, db: str, name: str, base: str, attempt: str, partition_by: list[str] | None = None, grace: float = GRACE
) -> None:
    """Point the table ``db.name`` at the folder ``base/attempt``, written in full, and remove what it has no use for.

    A table with the same columns and no partitions is switched in one catalog operation; one whose columns have changed, a
    partitioned one and a view are created anew, and readers may miss them for that moment.
    """
    path, full = f"{base}/{attempt}", f"{db}.{name}"
    kind = pointer_kind(spark, db, name)
    current = pointer_target(spark, db, name) if kind == "TABLE" else None
    outdated = pointer_previous(spark, db, name) if kind == "TABLE" else None
    written = spark.read.parquet(path).schema if kind == "TABLE" else None
    # the version before is noted first: a crash in between leaves it equal to the current one
    if kind == "TABLE" and not partition_by and spark.table(full).schema == written:
        spark.sql(f"ALTER TABLE {full} SET TBLPROPERTIES ('{PREVIOUS}' = '{current}')")
        spark.sql(f"ALTER TABLE {full} SET LOCATION '{path}'")
    else:
        if kind:
            spark.sql(f"DROP {kind} {full}")
        spark.catalog.createTable(full, path=path, source="parquet")
        if partition_by:
            spark.catalog.recoverPartitions(full)
        spark.sql(f"ALTER TABLE {full} SET TBLPROPERTIES ('{PREVIOUS}' = '{current or ''}')")
    spark.catalog.refreshTable(full)
    keep = {attempt, current}
    gone = set(left_behind(name, list_folder(spark, base), keep, grace))
    if outdated and outdated not in keep and (outdated == name.lower() or re.fullmatch(attempt_pattern(name), outdated)):
        gone.add(outdated)
    for folder in sorted(gone):
        remove_folder(spark, f"{base}/{folder}")


def _split(path: str) -> tuple[str, str]:
    parent, _, name = path.rstrip("/").rpartition("/")
    return parent, name


def folder_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def _rename(spark: SparkSession, old: str, new: str) -> None:
    fs, p = _hadoop(spark, old)
    if not fs.rename(p, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"cannot rename {old} to {new}")


def attempt_path(path: str) -> str:
    """A folder beside ``path`` for an attempt to write it."""
    parent, name = _split(path)
    return f"{parent}/{new_attempt(name)}"


def swap_folder(spark: SparkSession, attempt: str, path: str, grace: float = GRACE) -> None:
    """Give the folder ``attempt``, written in full, the name ``path``; the folder that had it goes.

    Two renames, and the first is undone if the second fails. A crash between them leaves the old rows beside ``path``;
    :func:`restore_folder` gives them their name back.
    """
    parent, name = _split(path)
    old = f"{path.rstrip('/')}__old"
    if folder_exists(spark, path):
        if folder_exists(spark, old):
            remove_folder(spark, old)
        _rename(spark, path.rstrip("/"), old)
        try:
            _rename(spark, attempt, path)
        except BaseException:
            _rename(spark, old, path.rstrip("/"))
            raise
        remove_folder(spark, old)
    else:
        _rename(spark, attempt, path)
    for folder in left_behind(name, list_folder(spark, parent), set(), grace):
        remove_folder(spark, f"{parent}/{folder}")


def restore_folder(spark: SparkSession, path: str) -> None:
    """After a crash between the renames of :func:`swap_folder`: the old rows get their name back."""
    old = f"{path.rstrip('/')}__old"
    if not folder_exists(spark, path) and folder_exists(spark, old):
        log.warning("restoring %s", path)
        _rename(spark, old, path.rstrip("/"))


# --- fixed values: how databases rename a table ------------------------------------------------
#: By the second part of the JDBC address; {old} and {new} are names with their schema, {new_name} without.
RENAMES = {
    "derby": "RENAME TABLE {old} TO {new_name}",
    "h2": "ALTER TABLE {old} RENAME TO {new_name}",
    "postgresql": "ALTER TABLE {old} RENAME TO {new_name}",
    "mysql": "RENAME TABLE {old} TO {new}",
    "mariadb": "RENAME TABLE {old} TO {new}",
}
# --- end of fixed values --------------------------------------------------------------------


def can_swap_tables(url: str) -> bool:
    return url.split(":")[1] in RENAMES


def suffixed(table: str, suffix: str) -> str:
    """``table`` (with its schema, if any; quoted or not) with a longer name."""
    quote = table[-1] if table[-1] in "\"`" else ""
    return f"{table[: -len(quote)] if quote else table}{suffix}{quote}"


def swap_tables(spark: SparkSession, target: dict, staging: str) -> None:
    """Give the JDBC table ``staging`` the name ``target["dbtable"]``, in one transaction; the table that had it goes.

    Where the database commits every rename by itself (MySQL), readers may miss the table for a moment, but a failed
    copy still leaves it alone.
    """
    url, table = target["url"], target["dbtable"]
    rename = RENAMES[url.split(":")[1]]
    jvm = spark.sparkContext._jvm
    if target.get("driver"):
        jvm.java.lang.Class.forName(target["driver"], True, jvm.java.lang.Thread.currentThread().getContextClassLoader())
    properties = jvm.java.util.Properties()
    for key in ("user", "password"):
        if target.get(key) is not None:
            properties.setProperty(key, str(target[key]))
    connection = jvm.java.sql.DriverManager.getConnection(url, properties)

    def run(sql: str) -> None:
        statement = connection.createStatement()
        try:
            statement.execute(sql)
        finally:
            statement.close()

    def renamed(old: str, new: str) -> str:
        return rename.format(old=old, new=new, new_name=new.rpartition(".")[2])

    old = suffixed(staging, "_o")
    try:
        try:
            run(f"SELECT 1 FROM {table} WHERE 1 = 0")
            present = True
        except Exception:  # no such table
            present = False
        connection.setAutoCommit(False)
        try:
            if present:
                run(renamed(table, old))
            run(renamed(staging, table))
            if present:
                run(f"DROP TABLE {old}")
            connection.commit()
        except BaseException:
            connection.rollback()
            raise
    finally:
        connection.close()


def drop_jdbc_table(spark: SparkSession, target: dict, table: str) -> None:
    """Drop a table another write has left behind; its absence is fine."""
    jvm = spark.sparkContext._jvm
    properties = jvm.java.util.Properties()
    for key in ("user", "password"):
        if target.get(key) is not None:
            properties.setProperty(key, str(target[key]))
    connection = jvm.java.sql.DriverManager.getConnection(target["url"], properties)
    try:
        connection.createStatement().execute(f"DROP TABLE {table}")
    except Exception as e:
        log.warning("not dropped: %s (%s)", table, str(e).splitlines()[0])
    finally:
        connection.close()


