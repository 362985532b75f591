"""Binary measurement records: [u16 n][source][u16 n][target][i64 ip version][f32 ms][i64 time], little-endian. The time is in
microseconds or, as some writers have it, in whole seconds. Records of a batch are taken apart and put together at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "src_addr string, dst_addr string, ip_version long, rtt float, time_us long"
TAIL = np.dtype([("ip_version", "<i8"), ("rtt", "<f4"), ("time", "<i8")])  # fixed values: what stands behind the addresses
UNITS = {"us": 1, "s": 1_000_000}


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8), offsets


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places begin, begin + 1, ... of all stretches, one behind the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _texts(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """Stretches as strings; empty ones are null."""
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    held = np.packbits(size > 0, bitorder="little").tobytes()
    out = pa.Array.from_buffers(pa.large_string(), len(size), [pa.py_buffer(held), pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[_spread(begin, size)].tobytes())])
    out.validate(full=True)
    return out.cast(pa.string())


def decode(df: DataFrame, column: str = "record", unit: str = "us") -> DataFrame:
    """Rows of SCHEMA; an empty address is null."""
    factor = UNITS[unit]

    def run(batches):
        for batch in batches:
            raw, offsets = _bytes(batch.column(0))
            begin, sides = offsets[:-1].astype(np.int64), []
            for _ in range(2):
                n = raw[begin].astype(np.int64) | raw[begin + 1].astype(np.int64) << 8 if len(begin) else np.zeros(0, np.int64)
                sides.append(_texts(raw, begin + 2, n))
                begin = begin + 2 + n
            tail = raw[begin[:, None] + np.arange(TAIL.itemsize)].view(TAIL).ravel() if len(begin) else np.zeros(0, TAIL)
            rest = [pa.array(tail["ip_version"]), pa.array(tail["rtt"]), pa.array(tail["time"] * factor)]
            yield pa.RecordBatch.from_arrays([*sides, *rest], names=["src_addr", "dst_addr", "ip_version", "rtt", "time_us"])

    return df.select(column).mapInArrow(run, SCHEMA)


def encode(df: DataFrame, unit: str = "us") -> DataFrame:
    """(record) from rows with SCHEMA's columns; with unit `s` times are cut to whole seconds."""
    factor = UNITS[unit]

    def run(batches):
        for batch in batches:
            n, parts = batch.num_rows, []
            for c in range(2):
                raw, offsets = _bytes(batch.column(c))
                size = np.diff(offsets)
                parts += [(size.astype("<u2").view(np.uint8), 2 * np.arange(n), np.full(n, 2)), (raw, offsets[:-1], size)]
            tail = np.zeros(n, TAIL)
            tail["ip_version"], tail["rtt"] = (batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
            tail["time"] = batch.column(4).to_numpy(zero_copy_only=False) // factor
            parts.append((tail.view(np.uint8), TAIL.itemsize * np.arange(n), np.full(n, TAIL.itemsize)))
            whole = sum(size for _, _, size in parts)
            offsets = np.concatenate([[0], np.cumsum(whole)]).astype(np.int64)
            out, at = np.zeros(int(offsets[-1]), np.uint8), offsets[:-1]
            for raw, begin, size in parts:
                out[_spread(at, size)] = raw[_spread(begin, size)]
                at = at + size
            record = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])
            yield pa.RecordBatch.from_arrays([record.cast(pa.binary())], names=["record"])

    return df.select("src_addr", "dst_addr", "ip_version", "rtt", "time_us").mapInArrow(run, "record binary")
