"""Document ids: 16 bytes, the creation time in milliseconds (big-endian) and eight random bytes."""

from __future__ import annotations

import re
import secrets
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.errors import InvalidArgument

_TEXT = re.compile(r"(?:[a-z]+_)?([0-9a-fA-F]{32})")


def fresh_id() -> bytes:
    return (time.time_ns() // 1_000_000).to_bytes(8, "big") + secrets.token_bytes(8)


def id_text(raw: bytes, prefix: str = "") -> str:
    return prefix + raw.hex()


def parse_id(text: str) -> bytes:
    """32 hexadecimal digits in either case, with or without a word and an underscore before them."""
    m = _TEXT.fullmatch(text)
    if not m:
        raise InvalidArgument(f"not a document id: {text!r}")
    return bytes.fromhex(m[1])


def key_id(*keys: str) -> Column:
    """Ids for imported rows that order as their keys do: the first key's eight bytes, then those of the
    second key, or zeros; more keys are hashed into the second half."""
    first = F.unhex(F.lpad(F.hex(F.col(keys[0]).cast("long")), 16, "0"))
    if len(keys) == 1:
        return F.concat(first, F.unhex(F.lit("00" * 8)))
    rest = F.col(keys[1]).cast("long") if len(keys) == 2 else F.xxhash64(*keys[1:])
    return F.concat(first, F.unhex(F.lpad(F.hex(rest), 16, "0")))
