"""String column expressions (all JVM-side, codegen'd)."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.spec import TRACK_URI_PREFIX, UNSAFE_NAME_CHARS


def _python_whitespace() -> str:
    """Every code point Python's ``str.strip()`` removes, derived from ``str.isspace``."""
    return "".join(chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace())


#: Characters removed by :func:`strip_ws` (same set as Python's ``str.strip()``).
WHITESPACE = _python_whitespace()
_WS_CLASS = "".join(f"\\x{{{ord(ch):x}}}" for ch in WHITESPACE)
_STRIP_PATTERN = f"^[{_WS_CLASS}]+|[{_WS_CLASS}]+$"


def strip_ws(col: Column | str) -> Column:
    """Remove leading/trailing whitespace of every kind (``trim`` keeps tabs)."""
    return F.regexp_replace(F.col(col) if isinstance(col, str) else col, _STRIP_PATTERN, "")


def sql_whitespace_literal() -> str:
    """The whitespace set as a SQL string literal, for ``trim(x, chars)`` oracles."""
    return "'" + WHITESPACE.replace("'", "''") + "'"


def remove_prefix(col: Column | str, prefix: str = TRACK_URI_PREFIX) -> Column:
    """Drop a literal, case-sensitive prefix if present; other values pass unchanged."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 1 << 30)).otherwise(c)


def id_from_href(col: Column | str) -> Column:
    """Trailing path segment of a URL: cut at the first ``?``, drop trailing ``/``.

    Empty or missing results become NULL. Fragments (``#top``) stay.
    """
    c = F.col(col) if isinstance(col, str) else col
    path = F.regexp_replace(F.regexp_replace(c, r"(?s)\?.*$", ""), "/+$", "")
    seg = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(c.isNull() | (c == ""), F.lit(None)).otherwise(F.nullif(seg, F.lit("")))


_UNSAFE_CLASS = "[" + "".join("\\" + ch if ch in '\\[]^-' else ch for ch in UNSAFE_NAME_CHARS) + "]"


def is_safe_name(col: Column | str) -> Column:
    """True when a playlist name is usable as a file stem.

    Non-blank after stripping, none of the unsafe characters, no leading or
    trailing dot. NULL names are unsafe.
    """
    c = F.col(col) if isinstance(col, str) else col
    s = strip_ws(c)
    return F.coalesce(
        (s != "") & ~s.startswith(".") & ~s.endswith(".") & ~s.rlike(_UNSAFE_CLASS),
        F.lit(False),
    )


def is_safe_name_py(name: object) -> bool:
    """Driver-side twin of :func:`is_safe_name` for a handful of names."""
    if not isinstance(name, str):
        return False
    s = name.strip()
    if not s or s.startswith(".") or s.endswith("."):
        return False
    return not any(ch in UNSAFE_NAME_CHARS for ch in s)
