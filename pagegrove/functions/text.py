"""String scalars (F1-F7).  All are native Column expressions.

Patterns are plain strings so the same text can be used by Spark (Java
regex) and by DuckDB (RE2) in the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------
# Characters that Python's str.split()/str.strip() treat as whitespace, in
# code point order: TAB LF VT FF CR, FS GS RS US, SPACE, NEL, NBSP,
# OGHAM SPACE MARK, EN QUAD..HAIR SPACE, LINE SEP, PARAGRAPH SEP,
# NARROW NBSP, MEDIUM MATH SPACE, IDEOGRAPHIC SPACE.
PY_WS_CHARS = (r"\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}"
               r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
# Characters JavaScript's String.prototype.trim() removes.
JS_WS_CHARS = (r"\t\n\x0b\x0c\r \xa0\x{1680}\x{2000}-\x{200a}"
               r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}")
# Python str.splitlines() boundaries (CRLF counts once).
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
# ---------------------------------------------------------------------------

PY_WS = f"[{PY_WS_CHARS}]"
PY_NON_WS = f"[^{PY_WS_CHARS}]"
PY_STRIP = f"^{PY_WS}+|{PY_WS}+$"
JS_STRIP = f"^[{JS_WS_CHARS}]+|[{JS_WS_CHARS}]+$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """Python ``str.strip()``."""
    return F.regexp_replace(_c(col), PY_STRIP, "")


def js_trim(col) -> Column:
    """JavaScript ``String.prototype.trim()``."""
    return F.regexp_replace(_c(col), JS_STRIP, "")


def sanitize_text(col) -> Column:
    """null/empty -> ''; collapse whitespace runs; trim the ends."""
    collapsed = F.regexp_replace(F.coalesce(_c(col), F.lit("")), f"{PY_WS}+", " ")
    return F.trim(collapsed)  # only ASCII spaces remain at the ends


def sanitize_filename(col) -> Column:
    """URL -> file name (the patterns are fixed values).  Drops scheme+host, maps non-word characters to
    '_', collapses '_', cuts to 200 code points, appends '.md' unless present
    and strips '_' and '.' from both ends (no lower-casing)."""
    x = F.regexp_replace(_c(col), r"^https?://[^/]+", "")
    x = F.regexp_replace(x, r"[^\p{L}\p{N}_\-.]", "_")
    x = F.regexp_replace(x, r"_+", "_")
    x = F.substring(x, 1, 200)
    x = F.when(x.endswith(".md"), x).otherwise(F.concat(x, F.lit(".md")))
    return F.regexp_replace(x, r"^[_.]+|[_.]+$", "")


def split_lines(col) -> Column:
    """Python ``str.splitlines()`` (no trailing empty element)."""
    c = _c(col)
    parts = F.split(c, LINE_BREAKS, -1)
    # splitlines drops the empty piece after a final line break
    return (F.when(c == "", F.array().cast("array<string>"))
            .when(c.rlike(f"({LINE_BREAKS})$"), F.slice(parts, 1, F.size(parts) - 1))
            .otherwise(parts))


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it in ``body`` (a lambda over the bound
    value).  Without it, a sub-expression used n times is copied n times into
    the tree -- and evaluated n times inside higher-order functions."""
    return F.transform(F.array(value), body)[0]


_EXPR_CACHE: dict = {}


def cached_expr(key, build):
    """Build a (large) Column expression once per SparkContext and reuse it.
    Column expressions are unresolved and refer to columns by name, so the
    same object can be applied to any DataFrame with those columns; building
    the navigation expressions costs thousands of driver-JVM calls."""
    from pyspark import SparkContext
    k = (SparkContext._active_spark_context.applicationId, key)
    if k not in _EXPR_CACHE:
        _EXPR_CACHE[k] = build()
    return _EXPR_CACHE[k]
