"""Record files of length-prefixed records, and the feature messages in them, without a protobuf library.

A file holds records of [length, 8 bytes little-endian][4 bytes checksum][data][4 bytes checksum]. A message holds a map from names
to lists of bytes, floats or whole numbers, in the protobuf wire format."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIXED = {1: 8, 5: 4}  # fixed values: sizes of wire types 1 and 5


def records(raw: bytes) -> Iterator[bytes]:
    at = 0
    while at + 12 <= len(raw):
        (n,) = struct.unpack_from("<Q", raw, at)
        if at + 16 + n > len(raw):
            raise ValueError("a record reaches over the end of its file")
        yield raw[at + 12 : at + 12 + n]
        at += 16 + n


def framed(data: bytes) -> bytes:
    """A record with checksums of zero: readers here don't look at them."""
    return struct.pack("<QI", len(data), 0) + data + struct.pack("<I", 0)


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def _fields(raw: bytes) -> Iterator[tuple[int, int, object]]:
    """(field number, wire type, value) of a message."""
    at = 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(raw, at)
        elif kind == 2:
            n, at = _varint(raw, at)
            value, at = raw[at : at + n], at + n
        elif kind in FIXED:
            value, at = raw[at : at + FIXED[kind]], at + FIXED[kind]
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, kind, value


def _values(kind: int, raw: bytes) -> list:
    out: list = []
    for number, wire, value in _fields(raw):
        if number != 1:
            continue
        if kind == 1:
            out.append(value)
        elif kind == 2:
            out += struct.unpack(f"<{len(value) // 4}f", value)
        elif wire == 0:
            out.append(value - (1 << 64) if value >> 63 else value)
        else:
            at = 0
            while at < len(value):
                x, at = _varint(value, at)
                out.append(x - (1 << 64) if x >> 63 else x)
    return out


def features(message: bytes) -> dict[str, list]:
    """Values by name: bytes, floats or whole numbers."""
    out = {}
    for number, _, body in _fields(message):
        for entry_number, _, entry in _fields(body) if number == 1 else ():
            if entry_number != 1:
                continue
            parts = {n: v for n, _, v in _fields(entry)}
            name = parts.get(1, b"").decode()
            out[name] = []
            for kind, _, values in _fields(parts.get(2, b"")):
                out[name] = _values(kind, values)
    return out


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, at, record): the records of all files; each file is read by one task."""

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list(records(raw))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(range(len(found)), pa.int64()), pa.array(found, pa.binary())], names=["path", "at", "record"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, at long, record binary")


def read_texts(spark: SparkSession, path: str, feature: str = "text", most: int | None = None) -> DataFrame:
    """Texts of a feature, stripped, empty ones left out; of the first `most` records of each file, if given."""

    def run(batches):
        for batch in batches:
            texts = [(features(r).get(feature) or [b""])[0].decode().strip() for r in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])

    rows = read_records(spark, path)
    rows = rows.where(F.col("at") < most) if most is not None else rows
    return rows.select("record").mapInArrow(run, "text string").where("text <> ''")


def read_numbers(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Lists of whole numbers of the named features; missing ones are empty."""

    def run(batches):
        for batch in batches:
            rows = [features(r) for r in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n, []) for r in rows], pa.list_(pa.int64())) for n in names], names=names)

    return read_records(spark, path).select("record").mapInArrow(run, ", ".join(f"`{n}` array<long>" for n in names))
