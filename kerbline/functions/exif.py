"""Capture time from the bytes of a JPEG: tag 0x9003 in the first directory or the Exif sub-directory."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def capture_time(data: bytes | None) -> str | None:
    """The tag's text, or None for anything that is not a JPEG with it."""
    if not data or data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        size = struct.unpack_from(">H", data, at + 2)[0]
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return _tiff(data[at + 10 : at + 2 + size])
        at += 2 + size
    return None


def _tiff(t: bytes) -> str | None:
    e = {b"II": "<", b"MM": ">"}.get(t[:2])
    if e is None or len(t) < 8:
        return None
    todo = [struct.unpack_from(e + "I", t, 4)[0]]
    try:
        for start in todo:
            for i in range(struct.unpack_from(e + "H", t, start)[0]):
                tag, kind, n, value = struct.unpack_from(e + "HHII", t, start + 2 + 12 * i)
                if tag == 0x9003 and kind == 2:
                    return t[value : value + n].split(b"\0")[0].decode("ascii", "replace")
                if tag == 0x8769 and len(todo) < 4:
                    todo.append(value)
    except struct.error:
        return None
    return None


@F.pandas_udf(StringType())
def capture_time_udf(content: pd.Series) -> pd.Series:
    return content.map(capture_time)
