"""Canonical JSON text of a VARIANT, as Python's ``json.dumps(value, ensure_ascii=False,
sort_keys=True, separators=(",", ":"))`` writes it (V10).

Keys are sorted at every depth, nothing is padded, non-ASCII stays as it is.
Whole numbers keep their digits; a number written with a fraction or an exponent is
the shortest text that reads back as the same double, in Python's form.

What VARIANT does not keep cannot come back: the sign of ``-0.0``, and whether a
number beyond 64 bits had a zero fraction (it is written as a whole number). Keys
outside the Basic Multilingual Plane sort by UTF-16 units.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordlake.functions import jsonx as J

# JSON's short escapes, the rest is \u00XX.
SHORT_ESCAPES = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
SPECIAL = r'[\x{00}-\x{1f}"\\]'
RARE = r"[\x{00}-\x{07}\x{0b}\x{0e}-\x{1f}]"
INTEGERS = ("BIGINT", "INT", "SMALLINT", "TINYINT")


def bind(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make(value)`` with ``value`` evaluated once, however often it is used."""
    return F.transform(F.array(value), make)[0]


def _replaced(c: Column, pairs: dict[str, str]) -> Column:
    for old, new in pairs.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def json_string(value: Column) -> Column:
    """A string with its quotes and escapes."""
    def quoted(s: Column) -> Column:
        escaped = _replaced(s, {"\\": "\\\\", '"': '\\"', **SHORT_ESCAPES})
        rare = {chr(c): f"\\u{c:04x}" for c in range(32) if chr(c) not in SHORT_ESCAPES}
        escaped = F.when(s.rlike(RARE), _replaced(escaped, rare)).otherwise(escaped)
        return F.concat(F.lit('"'), F.when(s.rlike(SPECIAL), escaped).otherwise(s), F.lit('"'))

    return bind(value, quoted)


def _shortest(text: Column, number: Column) -> Column:
    """(digits without trailing zeros, decimal exponent of the first one) of a positive double, from its Java text:
    the fewest digits, rounded from that text, that read back as the same double."""
    head = F.substring_index(text, "E", 1)
    power = F.when(text.contains("E"), F.substring_index(text, "E", -1).cast("int")).otherwise(F.lit(0))
    fraction = F.length(F.substring_index(head, ".", -1))
    whole = F.replace(head, F.lit(".")).cast("decimal(38,0)")
    scale = power - fraction  # value = whole * 10 ** scale
    digits = F.length(whole.cast("string"))

    def rounded(p: Column) -> Column:
        unit = F.rpad(F.lit("1"), digits - p + 1, F.lit("0")).cast("decimal(20,0)")
        return F.struct((F.floor(whole / unit + F.lit(0.5).cast("decimal(2,1)")) * unit).cast("decimal(38,0)").cast("string").alias("d"),
                        scale.alias("e"))

    fits = F.filter(F.transform(F.sequence(F.lit(1), F.least(digits, F.lit(17))), rounded),
                    lambda x: F.concat(x["d"], F.lit("E"), x["e"].cast("string")).cast("double") == number)
    best = F.coalesce(F.try_element_at(fits, F.lit(1)), F.struct(whole.cast("string").alias("d"), scale.alias("e")))
    return bind(best, lambda b: F.struct(F.regexp_replace(b["d"], "(?<=.)0+$", "").alias("d"),
                                         (F.length(b["d"]) - 1 + b["e"]).alias("e")))


def json_float(value: Column) -> Column:
    """A double as Python's ``repr`` (and ``Infinity``) writes it."""
    def exact(n: Column) -> Column:
        def shape(x: Column) -> Column:
            d, e, size = x["d"], x["e"], F.length(x["d"])
            plain = (F.when(e >= size - 1, F.concat(d, F.repeat(F.lit("0"), e - size + 1), F.lit(".0")))
                     .when(e >= 0, F.concat(d.substr(F.lit(1), e + 1), F.lit("."), d.substr(e + 2, size)))
                     .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), d)))
            mantissa = F.when(size == 1, d).otherwise(F.concat(d.substr(F.lit(1), F.lit(1)), F.lit("."), d.substr(F.lit(2), size)))
            power = F.concat(F.when(e < 0, "-").otherwise("+"), F.when(F.abs(e) < 10, "0").otherwise(""), F.abs(e).cast("string"))
            return F.when((e >= -4) & (e < 16), plain).otherwise(F.concat(mantissa, F.lit("e"), power))

        return F.concat(F.when(n < 0, "-").otherwise(""), bind(_shortest(F.abs(n).cast("string"), F.abs(n)), shape))

    def text(n: Column) -> Column:
        plain = n.cast("string")  # Java's and Python's text are the same for few digits near one
        near = (n == 0) | ((F.abs(n) >= 0.001) & (F.abs(n) < 1e7) & (F.length(plain) <= 14))
        return F.when(near, plain).when(F.abs(n) == float("inf"), plain).otherwise(exact(n))

    return bind(value, text)


def canonical_json(value: Column, depth: int = 6) -> Column:
    """The text of a VARIANT nested up to ``depth`` deep; NULL for NULL. What lies deeper is as Spark writes it."""
    def scalar(v: Column, kind: Column) -> Column:
        number = F.try_variant_get(v, "$", "double")
        wide = F.try_variant_get(v, "$", "decimal(38,0)").cast("string")
        large = kind.startswith("DECIMAL") & kind.endswith(",0)") & (F.abs(number) >= 2.0**63)
        return (F.when(kind == "STRING", json_string(F.try_variant_get(v, "$", "string")))
                .when(kind == "VOID", F.lit("null"))
                .when(kind.isin(*INTEGERS), F.try_variant_get(v, "$", "bigint").cast("string"))
                .when(kind == "BOOLEAN", F.try_variant_get(v, "$", "string"))
                .when(large, wide).otherwise(json_float(number)))

    def level(v: Column, left: int) -> Column:
        def typed(kind: Column) -> Column:
            if not left:
                nested = F.to_json(v)
                return F.when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), nested).otherwise(scalar(v, kind))
            is_object, is_array = kind.startswith("OBJECT"), kind.startswith("ARRAY")
            fields = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
            items = F.transform(F.try_variant_get(v, "$", "array<variant>"),
                                lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")))
            inner = F.array_join(F.transform(
                F.when(is_object, fields).when(is_array, items),
                lambda x: F.concat(F.when(x["key"].isNull(), F.lit("")).otherwise(F.concat(json_string(x["key"]), F.lit(":"))),
                                   level(x["value"], left - 1))), ",")
            # One use of ``inner``: two would double the expression at every level.
            wrapped = F.concat(F.when(is_object, "{").otherwise("["), inner, F.when(is_object, "}").otherwise("]"))
            return F.when(is_object | is_array, wrapped).otherwise(scalar(v, kind))

        return bind(J.vtype(v), typed)

    return F.when(value.isNotNull(), level(value, depth))
