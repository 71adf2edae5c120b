"""Values of facts: tags, Python wrappers, and the lanes that hold them in a log."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NIL, I64, U64_TAG, DECIMAL, STR, REF_TAG = range(6)
NAMES = {NIL: "Nil", I64: "I64", U64_TAG: "U64", DECIMAL: "Decimal", STR: "Str", REF_TAG: "Ref"}
LANES = {I64: "v_i64", U64_TAG: "v_u64", DECIMAL: "v_dec", STR: "v_str", REF_TAG: "v_ref"}
LANE_TYPES = {I64: T.LongType(), U64_TAG: T.DecimalType(20, 0), DECIMAL: T.DecimalType(38, 18), STR: T.StringType(), REF_TAG: T.LongType()}
ASSERT, RETRACT = 0, 1
LOG_SCHEMA = T.StructType(
    [T.StructField("e", T.LongType()), T.StructField("a", T.LongType()), T.StructField("vt", T.ByteType())]
    + [T.StructField(LANES[t], LANE_TYPES[t]) for t in sorted(LANES)]
    + [T.StructField("tx", T.LongType()), T.StructField("op", T.ByteType())]
)
_ID_MAX, _U64_MAX = 2**63 - 1, 2**64 - 1


@dataclass(frozen=True, order=True)
class Value:
    """A typed value. Values of different tags are never equal; they order by tag, then by content."""

    tag: int
    content: Any = None

    def __str__(self) -> str:
        if self.tag == NIL:
            return "Nil"
        text = '"%s"' % str(self.content).replace("\\", "\\\\").replace('"', '\\"') if self.tag == STR else format(self.content, "f") if self.tag == DECIMAL else str(self.content)
        return f"{NAMES[self.tag]}({text})"


def i64(x: int) -> Value:
    if not -(2**63) <= x < 2**63:
        raise ValueError(f"{x} is no 64-bit integer")
    return Value(I64, int(x))


def u64(x: int) -> Value:
    if not 0 <= x <= _U64_MAX:
        raise ValueError(f"{x} is no unsigned 64-bit integer")
    return Value(U64_TAG, int(x))


def ref(x: int) -> Value:
    if not 0 <= x <= _ID_MAX:
        raise ValueError(f"{x} is no entity id")
    return Value(REF_TAG, int(x))


def dec(x: Decimal | int | str) -> Value:
    return Value(DECIMAL, Decimal(x))


def text(x: str) -> Value:
    return Value(STR, x)


def value(x: Any) -> Value:
    """The value that a Python object stands for by itself: int I64, Decimal Decimal, str Str, None Nil."""
    if isinstance(x, Value):
        return x
    if x is None:
        return Value(NIL)
    if isinstance(x, bool) or isinstance(x, float):
        raise TypeError(f"{type(x).__name__} has no value type")
    if isinstance(x, int):
        return i64(x)
    if isinstance(x, Decimal):
        return dec(x)
    if isinstance(x, str):
        return text(x)
    raise TypeError(f"{type(x).__name__} has no value type")


def declared(x: Any, tag: int) -> Value:
    """``x`` read as the declared type where a Python object is ambiguous; a typed value stays what it is."""
    if isinstance(x, Value) or isinstance(x, (str, Decimal)) or x is None or isinstance(x, (bool, float)):
        return value(x)
    if isinstance(x, int):
        return {I64: i64, U64_TAG: u64, REF_TAG: ref, DECIMAL: dec}.get(tag, i64)(x)
    return value(x)


def datom(e: int, a: int, v: Value, tx: int, op: int = ASSERT) -> tuple:
    """One row of a log."""
    if max(e, a, tx) > _ID_MAX or min(e, a, tx) < 0:
        raise ValueError("ids are integers from 0 to 2^63-1")
    lanes = [None] * 5
    if v.tag in LANES:
        lanes[v.tag - 1] = Decimal(v.content) if v.tag == U64_TAG else v.content
    return (e, a, v.tag, *lanes, tx, op)


def value_of(row: tuple) -> Value:
    """The value of a row of a log, or of a collected dynamic column (vt and lanes)."""
    if len(row) == 10:
        row = row[2:8]
    tag = row[0]
    if tag == NIL or tag is None:
        return Value(NIL)
    x = row[tag]
    return Value(tag, int(x) if tag == U64_TAG else x)


def literal(v: Value) -> Column:
    return F.lit(v.content).cast(LANE_TYPES[v.tag]) if v.tag in LANES else F.lit(None)


def dynamic(tag: int, c: Column) -> Column:
    """A column of one type as the struct that holds any: its tag and lanes."""
    lanes = [(c if t == tag else F.lit(None)).cast(LANE_TYPES[t]).alias(LANES[t]) for t in sorted(LANES)]
    return F.struct(F.lit(tag).cast("tinyint").alias("vt"), *lanes)


def row_text(row: tuple) -> str:
    """A collected row of values as text, like [Str("Abbey Road"), U64(2)]."""
    return "[" + ", ".join(map(str, row)) + "]"


def text_column(tag: int | None, c: Column) -> Column:
    """A column of values of one type, or of dynamic ones (tag None), as text like Str("Abbey Road")."""
    if tag is None:
        out = F.lit(str(Value(NIL)))
        for t, lane in LANES.items():
            out = F.when(c["vt"] == t, text_column(t, c[lane])).otherwise(out)
        return out
    x = c.cast("string")
    if tag == STR:
        x = F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.coalesce(F.concat(F.lit(f"{NAMES[tag]}("), x, F.lit(")")), F.lit(str(Value(NIL))))


def row_text_column(columns: list[tuple[int | None, Column]]) -> Column:
    """A row of values as text, as row_text gives it, without leaving the executors."""
    return F.concat(F.lit("["), F.concat_ws(", ", *[text_column(t, c) for t, c in columns]), F.lit("]"))
