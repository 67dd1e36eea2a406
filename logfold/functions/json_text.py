"""Columns as JSON text with a two-space layout and ASCII escapes, byte for byte as Python's ``json.dumps(x, indent=2)``.

Empty lists and objects stay on one line, characters outside printable ASCII
become ``\\uXXXX`` (surrogate pairs beyond the basic plane), nulls are kept and
map entries stay in their order.  Structs, maps with string keys, arrays,
strings, whole numbers and booleans are encoded; other types are refused.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PLAIN = r'\A[ !#-\[\]-~]*\z'
#: Runs of plain characters, and every other character on its own.
_TOKENS = r'[ !#-\[\]-~]+|[\s\S]'
_SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\f": "\\f", "\b": "\\b"}


def _unit(code: Column) -> Column:
    """``\\uXXXX`` of a UTF-16 unit."""
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))


def _escaped(token: Column) -> Column:
    code = F.ascii(token)  # the code point of the first character
    beyond = code - 0x10000
    pair = F.concat(_unit(F.shiftright(beyond, 10) + 0xD800), _unit(beyond.bitwiseAND(0x3FF) + 0xDC00))
    out = F.when(token.rlike(_PLAIN), token)
    for ch, text in _SHORT.items():
        out = out.when(token == ch, F.lit(text))
    return out.when(code > 0xFFFF, pair).otherwise(_unit(code))


def json_string(c: Column) -> Column:
    """The JSON literal of a string column; only texts that need it are taken apart."""
    parts = F.transform(F.regexp_extract_all(c, F.lit(_TOKENS), F.lit(0)), _escaped)
    return F.concat(F.lit('"'), F.when(c.rlike(_PLAIN), c).otherwise(F.array_join(parts, "")), F.lit('"'))


def _block(items: Column, marks: str, depth: int) -> Column:
    """An array of item texts between brackets, one item a line."""
    line = "\n" + "  " * (depth + 1)
    body = F.concat(F.lit(marks[0] + line), F.array_join(items, "," + line), F.lit("\n" + "  " * depth + marks[1]))
    return F.when(F.size(items) == 0, F.lit(marks)).otherwise(body)


def indented_json(c: Column, kind: T.DataType, depth: int = 0) -> Column:
    """The JSON text of a column of type ``kind``; ``depth`` is the number of open brackets around it."""
    if isinstance(kind, T.StructType):
        fields = [F.concat(json_string(F.lit(f.name)), F.lit(": "), indented_json(c.getField(f.name), f.dataType, depth + 1)) for f in kind]
        text = _block(F.array(*fields), "{}", depth) if fields else F.lit("{}")
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entry = lambda e: F.concat(json_string(e["key"]), F.lit(": "), indented_json(e["value"], kind.valueType, depth + 1))
        text = _block(F.transform(F.map_entries(c), entry), "{}", depth)
    elif isinstance(kind, T.ArrayType):
        text = _block(F.transform(c, lambda x: indented_json(x, kind.elementType, depth + 1)), "[]", depth)
    elif isinstance(kind, T.StringType):
        text = json_string(c)
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        text = c.cast("string")
    else:
        raise TypeError(f"no JSON text for {kind.simpleString()}")
    return F.coalesce(F.when(c.isNotNull(), text), F.lit("null"))
