"""Records as JSON text, escaped as the application's serializer does by default.

Printable ASCII stands for itself but for characters that have a meaning in
HTML or JSON; these, control characters and all others are ``\\uXXXX`` (a
surrogate pair beyond the basic plane), with the short forms of five controls
and of the backslash.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# What is written as it is, and the short forms.
PLAIN = r"[ !#$%()*,\-./0-9:;=?@A-Z\[\]^_a-z{|}~]"
SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r", "\\": "\\\\"}
# ---------------------------------------------------------------------------


def _unit(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.hex(code), 4, "0"))


def _escaped(c: Column) -> Column:
    code = F.ascii(c).cast("bigint")
    above = code - 0x10000
    out = F.when(c.rlike(f"^{PLAIN}$"), c)
    for char, short in SHORT.items():
        out = out.when(c == char, F.lit(short))
    return out.when(code < 0x10000, _unit(code)).otherwise(F.concat(
        _unit(F.shiftright(above, 10) + 0xD800), _unit(above.bitwiseAND(F.lit(0x3FF)) + 0xDC00)))


def json_string(text: Column) -> Column:
    """A text as a JSON string; NULL as ``null``."""
    plain = text.rlike(f"^{PLAIN}*$") & ~F.contains(text, F.lit("\n"))
    body = F.when(plain, text).otherwise(F.array_join(F.transform(F.split(text, ""), _escaped), ""))
    return F.coalesce(F.concat(F.lit('"'), body, F.lit('"')), F.lit("null"))


def json_value(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return json_string(value)
    if isinstance(kind, (T.LongType, T.IntegerType, T.BooleanType)):
        return F.coalesce(value.cast("string"), F.lit("null"))
    if isinstance(kind, T.ArrayType):
        items = F.array_join(F.transform(value, lambda x: json_value(x, kind.elementType)), ",")
        return F.coalesce(F.concat(F.lit("["), items, F.lit("]")), F.lit("null"))
    raise TypeError(f"no JSON text for {kind.simpleString()}")


def json_object(fields: list[tuple[str, Column, T.DataType]]) -> Column:
    """An object with every field, in order."""
    parts = []
    for i, (name, value, kind) in enumerate(fields):
        parts += [F.concat(F.lit("," if i else "{"), json_string(F.lit(name)), F.lit(":")), json_value(value, kind)]
    return F.concat(*parts, F.lit("}")) if parts else F.lit("{}")
