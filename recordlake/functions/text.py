"""String scalars with Python ``str`` semantics, expressed as Spark Columns.

Python's ``str.split()`` / ``str.strip()`` treat every Unicode white-space code
point as a separator. Java's ``(?U)\\s`` covers all of them except the four
information separators U+001C..U+001F, so the class below adds those.
"""

from __future__ import annotations

import datetime as dt
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python whitespace as a Java regex character class.
PY_WS = r"[\s\x{1c}-\x{1f}]"
# The same characters one by one (all lie in the Basic Multilingual Plane).
PY_WS_CHARS = "".join(c for c in map(chr, range(0x10000)) if c.isspace())


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """``str.strip()``: drop leading and trailing Unicode white space; only the ends of a text are looked at."""
    return F.trim(_col(c), F.lit(PY_WS_CHARS))


def py_strip_column(name: str | Column) -> Column:
    """``py_strip`` of a column that costs nothing to evaluate (a named one, a lambda's variable): the end, for
    which ``trim`` walks the whole text, is left alone where the last byte is a visible ASCII character."""
    c = _col(name)
    plain_end = F.substring(c.cast("binary"), -1, 1).between(F.lit(b"\x21"), F.lit(b"\x7f"))
    return F.when(plain_end, F.ltrim(c, F.lit(PY_WS_CHARS))).otherwise(py_strip(c))


def blank_to_null(c: Column | str) -> Column:
    """Strip; an empty result becomes NULL."""
    # nullif evaluates its argument once (Spark rewrites it with a common expression).
    return F.nullif(py_strip(c), F.lit(""))


def collapse_ws(c: Column | str) -> Column:
    """``" ".join(s.strip().split())``."""
    return py_strip(F.regexp_replace(_col(c), rf"(?U){PY_WS}+", " "))


@cache
def _folding_table() -> tuple[str, str, dict[str, str]]:
    """Full case folding by its rule, ``str.casefold`` of every character: letters with one
    letter for them as two parallel strings, and those that become several."""
    folded = {c: c.casefold() for c in map(chr, range(0x110000)) if c.casefold() != c}
    single = {c: f for c, f in folded.items() if len(f) == 1}
    return "".join(single), "".join(single.values()), {c: f for c, f in folded.items() if len(f) > 1}


def casefold_exact(c: Column | str) -> Column:
    """Python's ``str.casefold`` in the JVM. ASCII text is lower-cased, other text goes through one
    ``translate``, and character by character where a letter becomes several (ß → ss)."""
    plain, to, several = _folding_table()

    def fold(s: Column) -> Column:
        table = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
        letters = F.transform(F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0)), lambda x: F.coalesce(table[x], x))
        spread = F.when(s.rlike("[" + "".join(several) + "]"), F.array_join(letters, "")).otherwise(s)
        return F.when(s.rlike(r"[^\x00-\x7f]"), F.translate(spread, plain, to)).otherwise(F.lower(s))

    return F.transform(F.array(_col(c)), fold)[0]


def canonical_token(c: Column | str, exact_casefold: bool = False) -> Column:
    """Whitespace collapse + strip + ``casefold`` (X1), or ``lower`` unless ``exact_casefold`` is set; they
    differ only on a handful of letters such as the German sharp s and the final sigma."""
    collapsed = collapse_ws(c)
    return casefold_exact(collapsed) if exact_casefold else F.lower(collapsed)


def canonical_token_py(value: str, exact_casefold: bool = False) -> str:
    """Driver-side twin of :func:`canonical_token` for query arguments."""
    collapsed = " ".join(value.strip().split())
    return collapsed.casefold() if exact_casefold else collapsed.lower()


def like_contains(value: str) -> str:
    """LIKE pattern for a case-folded substring test (F1).

    ``%`` and ``_`` typed by the user stay wildcards; a backslash is doubled
    so it matches itself instead of acting as Spark's LIKE escape.
    """
    return "%" + value.lower().replace("\\", "\\\\") + "%"


def shorten(stripped: Column | str, limit: int = 200, empty: str = "unexpected runtime failure") -> Column:
    """X16 on already-stripped text: blank -> default text; longer than ``limit``
    -> first ``limit`` characters, right-stripped, plus '...'."""
    s = _col(stripped)
    cut = F.regexp_replace(F.substring(s, 1, limit), rf"(?U){PY_WS}+$", "")
    return (F.when(s == "", F.lit(empty)).when(F.length(s) <= limit, s)
            .otherwise(F.concat(cut, F.lit("..."))))


def truncate_message(c: Column | str, limit: int = 200, empty: str = "unexpected runtime failure") -> Column:
    """Strip, then ``shorten`` (for short diagnostics; stage long texts with
    ``py_strip_column`` + ``shorten`` instead)."""
    return shorten(py_strip(c), limit, empty)


def comma_list(c: Column | str) -> Column:
    """Split on commas, strip items, drop blanks (keeps order)."""
    items = F.transform(F.split(_col(c), ","), lambda x: py_strip(x))
    return F.filter(items, lambda x: x != "")


def truthy_setting(c: Column | str) -> Column:
    """Boolean setting text; NULL/blank keep the default (NULL here)."""
    v = _col(c)
    return F.when(v.isNull() | (v == ""), F.lit(None).cast("boolean")).otherwise(
        F.lower(v).isin("1", "true", "yes", "on")
    )


def positive_integer(value: object, name: str) -> int:
    """X19 for arguments: the one rule for limits and whole-number settings; a boolean is no number."""
    if type(value) is int and value >= 1:
        return value
    raise ValueError(f"{name} must be a positive integer")


def integer_setting(c: Column | str) -> Column:
    """Whole-number setting text (>= 1); NULL/blank keep the default (NULL here), and
    anything else raises when it is evaluated."""
    v = py_strip(_col(c))
    number = F.when(v.rlike(r"^[+]?[0-9]+$"), v.try_cast("bigint"))
    return F.when(v.isNull() | (v == ""), F.lit(None).cast("bigint")).when(number >= 1, number).otherwise(
        F.raise_error(F.concat(F.lit("setting must be a positive integer: "), v)).cast("bigint"))


def second_clock(clock: dt.datetime | None = None) -> dt.datetime:
    """The given batch clock (naive means UTC) or the wall clock, as an
    aware UTC datetime at second precision. Aware values convert to Spark
    timestamps without depending on the process's local time zone."""
    now = clock or dt.datetime.now(dt.UTC)
    if now.tzinfo is None:
        now = now.replace(tzinfo=dt.UTC)
    return now.astimezone(dt.UTC).replace(microsecond=0)


def clock_literal(clock: dt.datetime) -> Column:
    """A timestamp literal for a clock, parsed from UTC text in the session time
    zone (UTC, see ``session.configure``) rather than from a local-time object."""
    return F.to_timestamp(F.lit(second_clock(clock).strftime("%Y-%m-%d %H:%M:%S")))


def iso_utc(c: Column | str) -> Column:
    """Render a timestamp as ISO-8601 UTC text with second precision and ``Z``."""
    return F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_iso(c: Column | str) -> Column:
    """Lenient ISO-8601 text -> timestamp (NULL when unparsable)."""
    v = F.regexp_replace(_col(c), "Z$", "+00:00")
    return F.coalesce(
        F.try_to_timestamp(v, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")),
        F.try_to_timestamp(v, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")),
        F.try_to_timestamp(v, F.lit("yyyy-MM-dd'T'HH:mm:ss")),
        F.try_to_timestamp(v, F.lit("yyyy-MM-dd HH:mm:ss")),
    )


def duration_seconds(started: Column | str, finished: Column | str) -> Column:
    """Whole seconds between two ISO texts, truncated toward zero; NULL if
    unfinished or unparsable."""
    a, b = parse_iso(started), parse_iso(finished)
    micros = F.unix_micros(b) - F.unix_micros(a)
    return F.when(a.isNotNull() & b.isNotNull(), (micros / F.lit(1_000_000)).cast("long"))
