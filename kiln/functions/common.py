"""Small Column helpers shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio4(num: Column | str, den: Column | str) -> Column:
    """``num / den`` rounded half-up to 4 places, 0.0 when ``den`` is 0.

    Integer arithmetic first, one double division last, so every
    engine returns the same double (no rounding ties on binary fractions).
    """
    n, d = col_of(num).cast("long"), col_of(den).cast("long")
    a = n * 20000 + d
    b = d * 2
    whole = ((a - a % b) / b).cast("long")  # exact: a - a % b is a multiple of b
    return F.when(d > 0, whole.cast("double") / 10000.0).otherwise(F.lit(0.0))


# fixed value: whitespace stripped around values (ASCII, no-break space, ideographic space)
WS_CLASS = "[ \\t\\n\\r\\f\\x0B\u00a0\u3000]"


def strip_all(c: Column | str) -> Column:
    """Remove leading and trailing whitespace of any kind (``trim`` takes spaces only)."""
    return F.regexp_replace(col_of(c), f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def digits_only(c: Column | str) -> Column:
    return F.regexp_replace(col_of(c), "[^0-9]", "")


_FIXED: dict = {}


def fixed_expr(builder):
    """Build a Column expression (or a tuple of them) once per JVM and reuse it.

    For expressions that name fixed columns only (``value``, ``min_value``...),
    such as the PII labels and masks: each Column call is a JVM round trip, and
    a catalog profile would otherwise rebuild the same large expression for
    every table. The expression is unresolved, so every plan resolves it anew.
    """
    import functools

    @functools.wraps(builder)
    def get(*args):
        from pyspark import SparkContext

        sc = SparkContext._active_spark_context
        owner = sc._jsc if sc is not None else None
        key = (builder.__module__, builder.__qualname__, args)
        hit = _FIXED.get(key)
        if hit is None or hit[0] is not owner:  # built under another context: build again
            hit = _FIXED[key] = (owner, builder(*args))
        return hit[1]

    return get
