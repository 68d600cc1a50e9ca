"""Binary documents, for exchange: a header, then tagged values; documents with their id and sorted fields.

Values in Python: None, bool, int, float, str, list, Doc, Millis (a timestamp) and DocId.  Every malformed
input is a Corruption error; what is too deep or too long cannot be encoded."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from larkspur.errors import Corruption, InvalidArgument

# Fixed values of the format: header, tags, limits.
MAGIC, VERSION = b"LKSP", 1
NULL, FALSE, TRUE, INT, FLOAT, TEXT, ARRAY, DOCUMENT, TIME, ID = range(10)
MAX_DEPTH, MAX_ITEMS = 254, 1 << 20


@dataclass(frozen=True)
class Millis:
    value: int


@dataclass(frozen=True)
class DocId:
    raw: bytes


@dataclass(frozen=True)
class Doc:
    id: bytes
    fields: dict = field(default_factory=dict)


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = n >> 7, n & 0x7F
        out.append(low | (0x80 if n else 0))
        if not n:
            return bytes(out)


def _sized(items: int, depth: int) -> bytes:
    if depth > MAX_DEPTH:
        raise InvalidArgument("a document nests too deeply")
    if items > MAX_ITEMS:
        raise InvalidArgument("a collection has too many items")
    return _varint(items)


def _put(v, depth: int) -> bytes:
    if v is None or isinstance(v, bool):
        return bytes([NULL if v is None else TRUE if v else FALSE])
    if isinstance(v, int):
        if not -(1 << 63) <= v < 1 << 63:
            raise InvalidArgument("an integer exceeds 64 bits")
        return bytes([INT]) + v.to_bytes(8, "big", signed=True)
    if isinstance(v, float):
        return bytes([FLOAT]) + (b"\x7f\xf8" + bytes(6) if math.isnan(v) else struct.pack(">d", v))
    if isinstance(v, str):
        raw = v.encode()
        return bytes([TEXT]) + _varint(len(raw)) + raw
    if isinstance(v, list):
        return bytes([ARRAY]) + _sized(len(v), depth) + b"".join(_put(x, depth + 1) for x in v)
    if isinstance(v, Doc):
        head = bytes([DOCUMENT]) + v.id + _sized(len(v.fields), depth)
        keys = sorted(v.fields, key=str.encode)
        return head + b"".join(_varint(len(k.encode())) + k.encode() + _put(v.fields[k], depth + 1) for k in keys)
    if isinstance(v, Millis):
        return bytes([TIME]) + v.value.to_bytes(8, "big", signed=True)
    if isinstance(v, DocId):
        return bytes([ID]) + v.raw
    raise InvalidArgument(f"{type(v).__name__} cannot be encoded")


def encode(doc: Doc) -> bytes:
    return MAGIC + struct.pack(">I", VERSION) + _put(doc, 0)


class _Input:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if len(self.data) - self.at < n:
            raise Corruption("the input ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def varint(self) -> int:
        out = 0
        for k in range(10):
            b = self.take(1)[0]
            out |= (b & 0x7F) << (7 * k)
            if not b & 0x80:
                if (k and not b) or out >= 1 << 64:
                    raise Corruption("a length is not minimal")
                return out
        raise Corruption("a length is too long")

    def text(self) -> str:
        try:
            return self.take(self.varint()).decode()
        except UnicodeDecodeError as e:
            raise Corruption("text is not UTF-8") from e

    def items(self, depth: int) -> int:
        n = self.varint()
        if depth > MAX_DEPTH or n > MAX_ITEMS:
            raise Corruption("a collection is too deep or too long")
        return n

    def value(self, depth: int):
        tag = self.take(1)[0]
        if tag in (NULL, FALSE, TRUE):
            return None if tag == NULL else tag == TRUE
        if tag in (INT, TIME):
            n = int.from_bytes(self.take(8), "big", signed=True)
            return n if tag == INT else Millis(n)
        if tag == FLOAT:
            return struct.unpack(">d", self.take(8))[0]
        if tag == TEXT:
            return self.text()
        if tag == ARRAY:
            return [self.value(depth + 1) for _ in range(self.items(depth))]
        if tag == DOCUMENT:
            doc = Doc(self.take(16), {})
            for _ in range(self.items(depth)):
                key = self.text()
                if key in doc.fields:
                    raise Corruption(f"field {key!r} comes twice")
                doc.fields[key] = self.value(depth + 1)
            return doc
        if tag == ID:
            return DocId(self.take(16))
        raise Corruption(f"unknown tag {tag}")


def decode(data: bytes) -> Doc:
    r = _Input(data)
    if r.take(4) != MAGIC or struct.unpack(">I", r.take(4))[0] != VERSION:
        raise Corruption("not a document of this format")
    if not data[8:9] or data[8] != DOCUMENT:
        raise Corruption("a document is expected")
    doc = r.value(0)
    if r.at != len(data):
        raise Corruption("bytes follow the document")
    return doc


def to_value(v):
    """A Spark value as a codec value; structs have no ids of their own here."""
    import datetime

    if isinstance(v, dict):
        return Doc(bytes(16), {k: to_value(x) for k, x in v.items()})
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
        return [to_value(x) for x in v]
    if isinstance(v, datetime.datetime):
        return Millis(int(v.timestamp() * 1000))
    if isinstance(v, (bytes, bytearray)):
        return DocId(bytes(v))
    return v.item() if hasattr(v, "item") else v


def exported(df: DataFrame) -> DataFrame:
    """_id, data: every document of a frame's visible(ids=True) rows in binary form."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cols = [c for c in b.columns if c != "_id"]
            out = []
            for r in b.to_dict("records"):
                kept = {c: None if r[c] is pd.NaT or (isinstance(r[c], float) and math.isnan(r[c]) and b[c].dtype == object) else to_value(r[c]) for c in cols}
                out.append(encode(Doc(bytes(r["_id"]), kept)))
            yield pd.DataFrame({"_id": b["_id"], "data": out})

    return df.mapInPandas(run, "_id binary, data binary")
