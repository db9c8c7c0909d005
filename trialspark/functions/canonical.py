"""Canonical JSON as a column expression: keys sorted at any depth, no blanks, ASCII, as the standard library writes it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Escapes of JSON by the UTF-16 unit: fixed values of the format.
ESCAPES = {"0022": '\\"', "005C": "\\\\", "0008": "\\b", "0009": "\\t", "000A": "\\n", "000C": "\\f", "000D": "\\r"}
#: Texts of these characters alone are written as they are.
PLAIN = r"^[\x20\x21\x23-\x5B\x5D-\x7E]*$"


def quoted(text: Column) -> Column:
    """A JSON string in ASCII: other characters as \\u and the hex of their UTF-16 units."""
    table = F.create_map(*[F.lit(x) for pair in ESCAPES.items() for x in pair])
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(.{4})"), F.lit(1))

    def written(u: Column) -> Column:
        ascii_ = F.char(F.conv(u, 16, 10).cast("int"))
        return F.coalesce(F.element_at(table, u), F.when(u.between("0020", "007E"), ascii_), F.concat(F.lit("\\u"), F.lower(u)))

    return F.concat(F.lit('"'), F.when(text.rlike(PLAIN), text).otherwise(F.array_join(F.transform(units, written), "")), F.lit('"'))


def _bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value evaluated once however often of() names it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def number(x: Column) -> Column:
    """A double by its shortest digits, with an exponent below 1e-4 and from 1e16 on.

    The JVM's own digits may be one more than needed, so 15 and 16 are tried first; a few subnormals keep theirs.
    """

    def parsed(raw: Column) -> Column:
        part = lambda i: F.regexp_extract(raw, r"^(-?)(\d+)\.(\d+)(?:[eE]([-+]?\d+))?$", i)
        return F.struct(part(1).alias("sign"), part(2).alias("whole"), part(3).alias("rest"), F.coalesce(part(4).try_cast("int"), F.lit(0)).alias("exponent"))

    def stripped(p: Column) -> Column:
        all_ = F.concat(p["whole"], F.when(p["rest"] == "0", "").otherwise(p["rest"]))
        own = F.regexp_replace(all_, r"^0+(?=\d)", "")
        point = F.length(p["whole"]) + p["exponent"] - (F.length(all_) - F.length(own))
        return F.struct(p["sign"].alias("sign"), F.regexp_replace(own, r"0+$", "").alias("digits"), point.alias("point"))

    def shown(p: Column) -> Column:
        digits, point = p["digits"], p["point"]
        zeros = lambda n: F.repeat(F.lit("0"), F.greatest(n, F.lit(0)))
        n = F.length(digits)
        fixed = (
            F.when(point <= 0, F.concat(F.lit("0."), zeros(-point), digits))
            .when(point >= n, F.concat(digits, zeros(point - n), F.lit(".0")))
            .otherwise(F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1)))
        )
        e = point - 1
        mantissa = F.when(n == 1, digits).otherwise(F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.lit("."), F.substr(digits, F.lit(2))))
        scientific = F.concat(mantissa, F.when(e < 0, "e-").otherwise("e+"), F.when(F.abs(e) < 10, "0").otherwise(""), F.abs(e).cast("string"))
        return F.concat(p["sign"], F.when((point > -4) & (point <= 16), fixed).otherwise(scientific))

    def written(x: Column) -> Column:
        fewer = [F.format_string(f"%.{n - 1}e", x) for n in (15, 16)]
        raw = F.coalesce(*[F.when(f.try_cast("double") == x, f) for f in fewer], x.cast("string"))
        zero = F.when(x.cast("string").startswith("-"), "-0.0").otherwise("0.0")
        finite = _bound(_bound(_bound(raw, parsed), stripped), shown)
        return F.when(x == 0, zero).when(F.isnan(x), "NaN").when(F.abs(x) == float("inf"), x.cast("string")).otherwise(finite)

    return _bound(x.cast("double"), written)


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """value of a type as canonical JSON; null is `null`. Map keys are strings, written in order of code points."""
    match kind:
        case T.StructType():
            out = canonical_object(kind, value.getField)
        case T.ArrayType():
            out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
        case T.MapType():
            entry = lambda e: F.concat(quoted(e["key"]), F.lit(":"), canonical_json(e["value"], kind.valueType))
            out = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(value), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)), entry), ","), F.lit("}"))
        case T.BooleanType() | T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType() | T.NullType():
            out = value.cast("string")
        case T.FloatType() | T.DoubleType():
            out = number(value)
        case T.StringType():
            out = quoted(value)
        case _:
            raise TypeError(f"no canonical JSON of {kind.simpleString()}")
    return F.when(value.isNull(), F.lit("null")).otherwise(out)


def canonical_object(kind: T.StructType, of: Callable[[str], Column] = F.col) -> Column:
    """The canonical JSON of an object whose fields are columns, or what of() makes of their names."""
    inner = [F.concat(quoted(F.lit(f.name)), F.lit(":"), canonical_json(of(f.name), f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
    return F.concat(F.lit("{"), F.concat_ws(",", *inner), F.lit("}"))


def comparable(value: Column, kind: T.DataType) -> Column:
    """A value that is equal to another of its kind, nulls to nulls, just where their canonical JSON is, and cheaper to make.

    Only what compares otherwise than it is written is turned: doubles to their digits, since -0.0 equals 0.0, and maps to
    sorted entries. Other values stay as they are.
    """
    match kind:
        case T.StructType():
            inner = [comparable(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
            out = F.struct(*inner) if inner else F.lit("{}")
        case T.ArrayType():
            out = F.transform(value, lambda x: comparable(x, kind.elementType))
        case T.MapType():
            entry = lambda e: F.struct(e["key"].alias("key"), comparable(e["value"], kind.valueType).alias("value"))
            out = F.array_sort(F.transform(F.map_entries(value), entry), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        case T.FloatType() | T.DoubleType():
            return value.cast("double").cast("string")
        case T.BooleanType() | T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType() | T.NullType() | T.StringType():
            return value
        case _:
            raise TypeError(f"no canonical JSON of {kind.simpleString()}")
    return F.when(value.isNotNull(), out)
