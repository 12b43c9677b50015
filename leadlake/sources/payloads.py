"""JSON payloads whose fields come, go and change type: parsed once to VARIANT, read field by field, no row lost."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_INTEGERS = ("byte", "short", "int", "long", "tinyint", "smallint", "integer", "bigint")


def kind_of(value: Column) -> Column:
    """``object``, ``array``, ``string``, ``boolean``, ``number`` or ``null``; null where there is no value."""
    s = F.schema_of_variant(value)
    return (F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string")
            .when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").when(s.isNotNull(), "number"))


def parsed(df: DataFrame, column: str, alias: str = "payload") -> DataFrame:
    """``df`` with the text ``column`` as VARIANT; null where it is no JSON (a name twice in one object is none either)."""
    return df.withColumn(alias, F.try_parse_json(column))


def _field(payload: Column, path: str, kind: str) -> tuple[Column, Column]:
    """The value as ``kind`` and the kind it has where it can't be read as that; an integer takes no fraction."""
    raw, value = F.try_variant_get(payload, path, "variant"), F.try_variant_get(payload, path, kind)
    if kind.lower() in _INTEGERS:
        number = F.try_variant_get(payload, path, "double")
        value = F.when((F.schema_of_variant(raw) == "BIGINT") | number.isNull() | (number == F.floor(number)), value)
    return value, F.when(raw.isNotNull() & ~F.is_variant_null(raw) & value.isNull(), kind_of(raw))


def typed_fields(df: DataFrame, payload: str, fields: Mapping[str, tuple[str, str]], text: str | None = None) -> DataFrame:
    """The columns of ``df`` without the payload, then a column for each of ``fields`` (name: path, type), ``reason``, ``unknown``.

    A value of another type is converted where it can be (a number written as a string, say); where not, the field is null and ``reason``
    names it with the kind it has. ``reason`` is ``no payload``, ``malformed`` (given the ``text`` column, to tell
    the two apart) or ``not an object`` where nothing can be read, and null where every field was absent, null or
    readable. ``unknown`` has the names at the top that no path of ``fields`` begins with, ascending. One row for each
    row of ``df``; columns of ``df`` with the name of a field are replaced."""
    p = F.col(payload)
    read = {name: _field(p, path, kind) for name, (path, kind) in fields.items()}
    known = [path.removeprefix("$").lstrip(".").split(".")[0].split("[")[0] for path, _ in fields.values()]
    entries = F.try_variant_get(p, "$", "map<string,variant>")
    nothing = F.when(F.col(text).isNull(), "no payload").otherwise("malformed") if text else F.lit("no payload")
    odd = F.array_join(F.array_compact(F.array(*[F.concat(F.lit(f"{n}: "), k) for n, (_, k) in read.items()])), ", ") if read else F.lit("")
    reason = F.when(p.isNull(), nothing).when(kind_of(p) != "object", "not an object").when(odd != "", odd)
    unknown = F.when(entries.isNotNull(), F.array_sort(F.array_except(F.map_keys(entries), F.array(*map(F.lit, known)) if known else F.array().cast("array<string>"))))
    names = [*read, "reason", "unknown"]
    kept = [c for c in df.columns if c != payload and c not in names]
    return df.select(*kept, *[v.alias(n) for n, (v, _) in read.items()], reason.alias("reason"), unknown.alias("unknown"))


def elements(df: DataFrame, payload: str, path: str) -> DataFrame:
    """A row for each element of the array at ``path``: the columns of ``df`` with the element as payload, and ``pos``
    from 0. Rows without such an array, or with an empty one, have none."""
    others = [c for c in df.columns if c not in (payload, "pos")]
    return df.select(*others, F.posexplode(F.try_variant_get(payload, path, "array<variant>")).alias("pos", payload))


def payload_shape(df: DataFrame, payload: str) -> DataFrame:
    """Rows ``field, kind, n``: how often each name at the top has a value of each kind. What drifts has several rows."""
    each = df.select(F.explode(F.try_variant_get(payload, "$", "map<string,variant>")).alias("field", "_value"))
    return each.select("field", kind_of(F.col("_value")).alias("kind")).groupBy("field", "kind").agg(F.count("*").alias("n"))
