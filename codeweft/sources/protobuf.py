"""Files as protocol buffer messages: a small codec of the wire format, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Field numbers of a file message and of its line counts (fixed values).
FIELDS = {"path": 1, "programming_language": 4, "errors": 6, "checksum": 7, "short_path": 8, "is_test": 9}
LINES_FIELD, LINES = 3, {"loc": 1, "lloc": 2, "cloc": 3}
COLUMNS = "file_id string, path string, short_path string, programming_language string, checksum string, is_test boolean, errors array<string>, loc int, lloc int, cloc int"


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _text(field: int, value: str | bytes) -> bytes:
    data = value.encode() if isinstance(value, str) else value
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def encode(row: dict) -> bytes:
    """The message of one file; null values are left out, as the format has no nulls."""
    out = b""
    for name, field in FIELDS.items():
        value = row[name]
        if name == "errors":
            out += b"".join(_text(field, e) for e in (value if value is not None else []) if e is not None)
        elif name == "is_test":
            out += _varint(field << 3) + _varint(1) if value is True else b""
        elif isinstance(value, str) and value:
            out += _text(field, value)
    lines = b"".join(_varint(f << 3) + _varint(int(row[n])) for n, f in LINES.items() if row[n] is not None and not pd.isna(row[n]) and row[n])
    return out + (_text(LINES_FIELD, lines) if lines else b"")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0

    def varint() -> int:
        nonlocal at
        shift = n = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 0x7F) << shift
            shift += 7
            if not b & 0x80:
                return n

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        elif kind in (1, 5):  # numbers of fixed width, of which a file has none
            at += 8 if kind == 1 else 4
        else:
            raise ValueError(f"wire type {kind}")


def decode(data: bytes) -> dict:
    """One file of a message; unknown fields are passed over, missing ones have the format's defaults ('' , false, 0)."""
    names = {v: k for k, v in FIELDS.items()}
    row: dict = {"path": "", "programming_language": "", "errors": [], "checksum": "", "short_path": "", "is_test": False, "loc": 0, "lloc": 0, "cloc": 0}
    for field, value in _fields(data):
        if field == LINES_FIELD:
            inner = {v: k for k, v in LINES.items()}
            row.update({inner[f]: v for f, v in _fields(value) if f in inner})
        elif field in names:
            name = names[field]
            if name == "errors":
                row["errors"].append(value.decode())
            else:
                row[name] = bool(value) if name == "is_test" else value.decode()
    return row


def dump(files: DataFrame) -> DataFrame:
    """``(file_id, message)`` of ``files`` with the columns of COLUMNS."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"file_id": b["file_id"], "message": [encode(r) for r in b.astype(object).where(b.notna(), None).to_dict("records")]})

    return files.select(*[c.split()[0] for c in COLUMNS.split(", ")]).mapInPandas(run, "file_id string, message binary")


def load_messages(messages: DataFrame) -> DataFrame:
    """The files (COLUMNS) of ``messages(file_id, message)``."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"file_id": f, **decode(bytes(m))} for f, m in zip(b["file_id"], b["message"])]
            yield pd.DataFrame(rows, columns=names)

    return messages.mapInPandas(run, COLUMNS)
