"""Raw batches to single messages: protobuf envelopes and newline-delimited text, neighbours spared from a bad message."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VARINT, FIXED64, BYTES, FIXED32 = 0, 1, 2, 5


def varint(data: memoryview, at: int) -> tuple[int, int]:
    """Value and end of a variable-length number."""
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("bad varint")
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def fields(data: memoryview) -> Iterator[tuple[int, int, int | memoryview]]:
    """Number, wire type and value of each field of a message, in order."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        number, kind = tag >> 3, tag & 7
        if kind == VARINT:
            value, at = varint(data, at)
        else:
            if kind == BYTES:
                size, at = varint(data, at)
            elif kind in (FIXED64, FIXED32):
                size = 8 if kind == FIXED64 else 4
            else:
                raise ValueError("bad wire type")
            if number == 0 or at + size > len(data):
                raise ValueError("field is cut")
            value, at = data[at : at + size], at + size
        yield number, kind, value


def split_batches(rows: DataFrame, key: str, payload: str, field: int) -> DataFrame:
    """key, pos, message for each message in a repeated field of payload (binary); messages aren't decoded.

    A payload that breaks off gives one row with pos -1 and a null message, beside nothing else of that payload: its
    sender sends all of it again. A null payload is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, pos, messages = [], [], []
            for i, data in enumerate(batch.column(1)):
                try:
                    found = [bytes(v) for n, kind, v in fields(memoryview(data.as_buffer() or b"").cast("B")) if n == field and kind == BYTES]
                except ValueError:
                    found = None
                at += [i] * (1 if found is None else len(found))
                pos += [-1] if found is None else range(len(found))
                messages += [None] if found is None else found
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), pa.array(messages, pa.binary())], names=[key, "pos", "message"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, payload).mapInArrow(run, f"{key} {kind}, pos int, message binary")


def decode(rows: DataFrame, message: str, layout: dict[int, tuple[str, str]]) -> DataFrame:
    """Add the fields of message by layout, {number: (name, string | long)}, and ok; absent fields have their zero value.

    What can't be read has ok false and null fields. Of a repeated field the last counts."""
    names = [n for n, _ in layout.values()]
    kinds = {"string": pa.string(), "long": pa.int64()}
    wanted = {"string": BYTES, "long": VARINT}

    def read(data: pa.Scalar) -> tuple:
        if not data.is_valid:
            return (*([None] * len(names)), False)
        try:
            got = {n: v for n, kind, v in fields(memoryview(data.as_buffer()).cast("B")) if n in layout and kind == wanted[layout[n][1]]}
            out = [bytes(got[n]).decode() if n in got and k == "string" else got.get(n, 0 if k == "long" else "") for n, (_, k) in layout.items()]
            if any(isinstance(v, int) and v >= 1 << 63 for v in out):
                raise ValueError("number is too large")
            return (*out, True)
        except ValueError:
            return (*([None] * len(names)), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*map(read, batch.column(message)), strict=True)) or [[]] * (len(names) + 1)
            arrays = [pa.array(c, t) for c, t in zip(cols, [*(kinds[k] for _, k in layout.values()), pa.bool_()], strict=True)]
            yield pa.record_batch([*batch.columns, *arrays], names=[*batch.schema.names, *names, "ok"])

    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{own}, {', '.join(f'{n} {k}' for n, k in layout.values())}, ok boolean")


def varint_hex(n: Column) -> Column:
    """Hexadecimal digits of a whole number below 2^35, as a varint."""
    byte = lambda i: F.shiftrightunsigned(n, 7 * i).bitwiseAND(127).bitwiseOR(F.when(n >= 1 << (7 * (i + 1)), 128).otherwise(0))
    return F.concat(*[F.lpad(F.hex(byte(i)), 2, "0") if not i else F.when(n >= 1 << (7 * i), F.lpad(F.hex(byte(i)), 2, "0")).otherwise("") for i in range(5)])


def split_lines(rows: DataFrame, key: str, body: str) -> DataFrame:
    """key, pos, line of each line of body that isn't blank, without the space around it; pos counts all lines."""
    line = F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))
    return rows.select(key, F.posexplode(F.split(F.coalesce(body, F.lit("")), "\n")).alias("pos", "line")).withColumn("line", line).where("line <> ''")
