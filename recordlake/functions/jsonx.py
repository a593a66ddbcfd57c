"""Strict JSON parsing and type-exact access into VARIANT values.

Spark's JSON parsers stop at the end of the first value and ignore what
follows (``{"a":1} junk`` parses); Python's ``json.loads`` rejects it.
``well_formed`` closes that gap with two independent probes:

* wrapping the text in ``[...]`` must give an array of exactly one element
  (rejects ``1,2`` and ``{"a":1}{"b":2}``), and
* embedding it as a value before a sentinel key, ``{"r":<text>,"_z":0}``,
  must still let the parser reach the sentinel (rejects trailing garbage and
  lone fragments such as ``"x":1`` that the first probe would accept).

Type tests use ``schema_of_variant`` rather than casting, because a cast
turns ``5`` into ``'5'`` and would accept what the record contract refuses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER_TYPES = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def well_formed(text: Column | str) -> Column:
    t = _col(text)
    one_value = F.expr("1") == F.json_array_length(F.concat(F.lit("["), t, F.lit("]")))
    sentinel = F.try_variant_get(
        F.try_parse_json(F.concat(F.lit('{"r":'), t, F.lit(',"_z":0}'))), "$._z", "int"
    )
    return F.coalesce(one_value & (sentinel == 0), F.lit(False))


def parse(text: Column | str) -> Column:
    """VARIANT of well-formed text, else NULL.

    The value is taken from the sentinel probe itself (``$.r`` of
    ``{"r":<text>,"_z":0}``), so a line is parsed into a VARIANT once; the
    array probe only counts elements.
    """
    t = _col(text)
    probe = F.try_parse_json(F.concat(F.lit('{"r":'), t, F.lit(',"_z":0}')))
    one_value = F.expr("1") == F.json_array_length(F.concat(F.lit("["), t, F.lit("]")))
    ok = F.coalesce(one_value & (F.try_variant_get(probe, "$._z", "int") == 0), F.lit(False))
    return F.when(ok, F.try_variant_get(probe, "$.r", "variant"))


def node(v: Column, path: str) -> Column:
    """Sub-value at ``path``; JSON ``null`` and a missing path both give NULL."""
    sub = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(sub) != "VOID", sub)


def vtype(v: Column, path: str | None = None) -> Column:
    """Type name of the value (``STRING``, ``BIGINT``, ``OBJECT<...>``, ``VOID``), NULL if absent."""
    sub = v if path is None else F.try_variant_get(v, path, "variant")
    return F.schema_of_variant(sub)


def is_object(v: Column, path: str | None = None) -> Column:
    return F.coalesce(vtype(v, path).startswith("OBJECT"), F.lit(False))


def is_array(v: Column, path: str | None = None) -> Column:
    return F.coalesce(vtype(v, path).startswith("ARRAY"), F.lit(False))


def is_null_or_absent(v: Column, path: str) -> Column:
    t = vtype(v, path)
    return t.isNull() | (t == "VOID")


def is_string(v: Column, path: str | None = None) -> Column:
    return F.coalesce(vtype(v, path) == "STRING", F.lit(False))


def is_number(v: Column, path: str | None = None) -> Column:
    t = vtype(v, path)
    return F.coalesce(t.isin(*NUMBER_TYPES) | t.startswith("DECIMAL"), F.lit(False))


def typed_str(v: Column, path: str | None = None) -> Column:
    """The string at ``path`` only when it is a JSON string (numbers are not stringified)."""
    if path is None:
        return F.when(is_string(v), F.try_variant_get(v, "$", "string"))
    return F.when(is_string(v, path), F.try_variant_get(v, path, "string"))


def typed_double(v: Column, path: str | None = None) -> Column:
    """The number at ``path`` as double, only when it is a JSON number (not bool/string)."""
    p = "$" if path is None else path
    return F.when(is_number(v, path), F.try_variant_get(v, p, "double"))


def variant_array(v: Column, path: str) -> Column:
    """``ARRAY<VARIANT>`` when the value at ``path`` is a JSON array, else NULL."""
    return F.when(is_array(v, path), F.try_variant_get(v, path, "array<variant>"))


def object_keys_in_order(text: Column | str) -> Column:
    """Top-level keys in text order (duplicates kept), NULL if not an object."""
    return F.json_object_keys(_col(text))


def evaluate_once(df, keep: list[str], named: dict[str, Column]):
    """Project ``named`` expressions as generator output (``inline`` of a
    one-element array of structs).

    A filter on a generated column cannot be pushed below the generator, so
    Catalyst never copies these (expensive, parse-heavy) expressions into pushed
    down predicates or join conditions: each is evaluated once per row.
    """
    packed = F.array(F.struct(*[c.alias(n) for n, c in named.items()]))
    return df.select(*keep, F.inline(packed))
