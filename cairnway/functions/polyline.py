"""Encoded polylines (six decimals) as Arrow-batched UDFs: variable-length zig-zag deltas have no built-in form."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LINE = "array<struct<lat:double,lon:double>>"


def _pack(number: int) -> str:
    bits, out = (number << 1) ^ (number >> 63), []
    while bits >= 32:
        out.append(chr((32 | bits & 31) + 63))
        bits >>= 5
    return "".join([*out, chr(bits + 63)])


def encode_line(points) -> str:
    last, out = (0, 0), []
    for p in points:
        here = (round(p["lat"] * 1e6), round(p["lon"] * 1e6))
        out += [_pack(a - b) for a, b in zip(here, last, strict=True)]
        last = here
    return "".join(out)


def decode_line(text: str) -> list[dict]:
    numbers, value, shift = [], 0, 0
    for ch in text:
        code = ord(ch) - 63
        value, shift = value | (code & 31) << shift, shift + 5
        if code < 32:
            numbers.append(~(value >> 1) if value & 1 else value >> 1)
            value = shift = 0
    lat = lon = 0
    out = []
    for a, b in zip(numbers[::2], numbers[1::2], strict=True):
        lat, lon = lat + a, lon + b
        out.append({"lat": lat / 1e6, "lon": lon / 1e6})
    return out


def encode_polyline(line) -> Column:
    """array<struct<lat, lon>> -> text."""

    def there(lines: pd.Series) -> pd.Series:
        return lines.map(lambda p: None if p is None else encode_line(p))

    return F.pandas_udf(there, "string")(line)


def decode_polyline(text) -> Column:
    """Text -> array<struct<lat, lon>>."""

    def back(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else decode_line(t))

    return F.pandas_udf(back, LINE)(text)
