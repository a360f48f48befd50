"""Arrow UDFs, for what no built-in expresses: ciphers, wire formats, charsets, HTML, segmentation."""

from __future__ import annotations

import base64
import functools
import html
import math
from collections.abc import Callable
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Stream:
    """The bytes that a key's cipher adds to data. They depend on the key alone, so they are made once, as far as the longest data went."""

    def __init__(self, key: bytes):
        if not key:
            raise ValueError("the key is empty")
        box, j = list(range(256)), 0
        for i in range(256):
            j = (j + box[i] + key[i % len(key)]) & 255
            box[i], box[j] = box[j], box[i]
        self.box, self.i, self.j, self.made = box, 0, 0, b""

    def upto(self, n: int) -> np.ndarray:
        if n > len(self.made):
            box, i, j, more = self.box, self.i, self.j, bytearray()
            for _ in range(max(n - len(self.made), len(self.made) // 4, 256)):
                i = (i + 1) & 255
                j = (j + box[i]) & 255
                box[i], box[j] = box[j], box[i]
                more.append(box[(box[i] + box[j]) & 255])
            self.i, self.j, self.made = i, j, self.made + bytes(more)
        return np.frombuffer(self.made, np.uint8)[:n]


_stream = functools.lru_cache(maxsize=8)(_Stream)


def rc4(data: bytes, key: bytes) -> bytes:
    return (np.frombuffer(data, np.uint8) ^ _stream(bytes(key)).upto(len(data))).tobytes()


def spans(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, where each value starts, its size) of a binary column; nulls may have a size."""
    wide = pa.types.is_large_binary(values.type)
    _, places, data = values.buffers()
    at = np.frombuffer(places, np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8), at[:-1], np.diff(at)


def binary_array(body: np.ndarray, sizes: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """A binary column of values that stand one after the other."""
    places = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=places[1:])
    if places[-1] >= 1 << 31:
        raise ValueError("over 2 GB of values in a batch")
    bits = None if valid is None or valid.all() else pa.array(valid).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(sizes), [bits, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(body))])


def rc4_array(values: pa.Array, key: bytes) -> pa.Array:
    """`rc4` of each value; null for null."""
    if values.null_count == len(values):
        return values
    data, starts, sizes = spans(values)
    body, stream = data[starts[0] : starts[-1] + sizes[-1]], _stream(bytes(key)).upto(int(sizes.max()))
    starts = starts - starts[0]
    if len(body) > 256 * len(sizes):  # long ones: places of single bytes would take eight times their room
        out = np.empty_like(body)
        for a, n in zip(starts.tolist(), sizes.tolist(), strict=True):
            np.bitwise_xor(body[a : a + n], stream[:n], out=out[a : a + n])
    else:
        out = body ^ stream[np.arange(len(body)) - np.repeat(starts, sizes)]
    return binary_array(out, sizes, values.is_valid().to_numpy(zero_copy_only=False))


def rc4_column(data: Column, key: bytes) -> Column:
    """Enciphers or deciphers binary values; the key is the caller's."""

    @F.arrow_udf("binary")
    def run(values: pa.Array) -> pa.Array:
        return rc4_array(values, key)

    return run(data)


def wire_fields(data: bytes) -> list[tuple[int, int, int | bytes]]:
    """(field number, wire type, value) of a protobuf message; ValueError if it is cut short."""
    out, at = [], 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            if at >= len(data) or shift > 63:
                raise ValueError("truncated")
            value |= (data[at] & 127) << shift
            at += 1
            if data[at - 1] < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) if kind != 2 else varint()
            if size is None or at + size > len(data):
                raise ValueError("truncated or unknown wire type")
            value = data[at : at + size]
            at += size
        out.append((tag >> 3, kind, value))
    return out


def wire_encode(fields: list[tuple[int, int | bytes]]) -> bytes:
    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    return b"".join(varint(n << 3) + varint(v) if isinstance(v, int) else varint(n << 3 | 2) + varint(len(v)) + v for n, v in fields)


def message_column(data: Column, fields: dict[str, tuple[int, str]]) -> Column:
    """A struct of named fields (number, kind) of protobuf messages; kinds: long, string, bytes, double. Null if malformed; last value of a field counts."""
    import struct

    sparks = {"long": T.LongType(), "string": T.StringType(), "bytes": T.BinaryType(), "double": T.DoubleType()}
    schema = T.StructType([T.StructField(n, sparks[k]) for n, (_, k) in fields.items()])

    def one(v: bytes | None) -> dict:
        out = dict.fromkeys(fields)
        if v is None:
            return out
        try:
            found = {n: x for n, _, x in wire_fields(bytes(v))}
        except ValueError:
            return out
        for name, (number, kind) in fields.items():
            x = found.get(number)
            if x is None:
                continue
            if kind == "long" and isinstance(x, int):
                out[name] = x - (1 << 64) if x >= 1 << 63 else x
            elif kind == "string" and isinstance(x, bytes):
                out[name] = x.decode(errors="replace")
            elif kind == "bytes" and isinstance(x, bytes):
                out[name] = x
            elif kind == "double" and isinstance(x, bytes) and len(x) == 8:
                out[name] = struct.unpack("<d", x)[0]
        return out

    @F.pandas_udf(schema)
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(v) for v in values], columns=list(fields))

    return run(data)


def url_base64(text: Column) -> Column:
    """Decodes URL-safe base64, with or without padding; JVM-side."""
    return F.unbase64(F.translate(text, "-_", "+/"))


def to_url_base64(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


def tolerant(data: bytes, charset: str) -> tuple[float, str]:
    """(share of bytes that don't decode, the rest as text)."""
    wrong, at, parts = 0, 0, []
    while at < len(data):
        try:
            parts.append(data[at:].decode(charset))
            break
        except UnicodeDecodeError as e:
            parts.append(data[at : at + e.start].decode(charset))
            wrong += e.end - e.start
            at += e.end
    return (wrong / len(data) if data else 0.0), "".join(parts)


def tolerant_decode(data: Column, charset: str) -> Column:
    """struct<errors double, text string>: bytes that don't decode are left out and counted."""

    @F.pandas_udf("errors double, text string")
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if v is None else tolerant(bytes(v), charset) for v in values], columns=["errors", "text"])

    return run(data)


def tolerant_encode(text: Column, charset: str) -> Column:
    """The bytes of a text in a charset, less the characters that it lacks."""

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else v.encode(charset, errors="ignore"))

    return run(text)


#: Fixed value: the log of all characters counted in the samples that popularity comes from.
_LOG_TOTAL = 20.39


def guessed(data: bytes, popularity: dict[str, float]) -> tuple[str, str]:
    """(text, charset): Latin if all bytes are ASCII; of GBK and UTF-8 that which decodes; if both do, the one whose characters' log-shares sum higher.

    If neither does, Big5 if that decodes, else whichever of the two has fewer undecodable bytes, without them.
    """
    if data and all(0 < b < 127 for b in data):
        return data.decode("latin-1"), "latin"
    found = {}
    for name in ("gbk", "utf-8"):
        try:
            found[name] = data.decode(name)
        except UnicodeDecodeError:
            continue
    if len(found) == 2 and found["gbk"] != found["utf-8"]:
        score = {name: sum(math.log(popularity.get(c, 1)) - _LOG_TOTAL for c in text) for name, text in found.items()}
        return (found["utf-8"], "utf-8") if score["gbk"] < score["utf-8"] else (found["gbk"], "gbk")
    if found:
        name = "utf-8" if "utf-8" in found else "gbk"
        return found[name], name
    try:
        return data.decode("big5"), "big5"
    except UnicodeDecodeError:
        (_, text), name = min((tolerant(data, name), name) for name in ("gbk", "utf-8"))
        return text, name


def smart_decode(data: Column, popularity: dict[str, float]) -> Column:
    """struct<text, charset> of bytes in an unknown charset; popularity: how often each character occurs, a bounded table."""

    @F.pandas_udf("text string, charset string")
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if v is None else guessed(bytes(v), popularity) for v in values], columns=["text", "charset"])

    return run(data)


#: How punctuation is written.
PUNCTUATION = {"、": "-", "，": "-", "？": "", "。": "-", "《": "", "》": ""}


def transliterate(text: Column, readings: dict[str, str]) -> Column:
    """Each character's reading, punctuation as hyphens or nothing; others pass through. readings: a bounded table of some thousand characters."""
    table = str.maketrans(readings | PUNCTUATION)

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else v.translate(table))

    return run(text)


def unescape(text: Column) -> Column:
    """Character references decoded."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else html.unescape(v))

    return run(text)


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def singly(values: pa.Array, of: Callable[[str], str]) -> pa.Array:
    """A function of each text, null for null. Beside the batch little more than the column that is returned is held: Python's texts of 1 MB at a time, and one that is read."""
    parts, some, size = [], [], 0
    for v in values:
        some.append(of(v.as_py()) if v.is_valid else None)
        size += len(some[-1] or "")
        if size > 1 << 20 or len(some) == 1000:
            parts.append(pa.array(some, pa.string()))
            some, size = [], 0
    parts.append(pa.array(some, pa.string()))
    out = pa.concat_arrays(parts)
    del parts
    pa.default_memory_pool().release_unused()
    return out


def visible(page: str) -> str:
    parser = _Text()
    parser.feed(page)
    parser.close()
    return " ".join(" ".join(parser.parts).split())


def html_text(page: Column) -> Column:
    """All visible text of lenient HTML, single blanks."""

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return singly(values, visible)

    return run(page)


def segment(text: Column, words: dict[str, float]) -> Column:
    """Words of the likeliest segmentation over a bounded dictionary of log-probabilities; unknown characters stand alone."""
    longest = max(map(len, words), default=1)
    unknown = min(words.values(), default=0.0) - 10

    @F.pandas_udf("array<string>")
    def run(values: pd.Series) -> pd.Series:
        def one(v: str | None) -> list[str] | None:
            if v is None:
                return None
            best: list[tuple[float, int]] = [(0.0, 0)]
            for end in range(1, len(v) + 1):
                best.append(max((best[a][0] + words.get(v[a:end], unknown if end - a == 1 else -math.inf), a) for a in range(max(0, end - longest), end)))
            out, end = [], len(v)
            while end:
                out.append(v[best[end][1] : end])
                end = best[end][1]
            return out[::-1]

        return values.map(one)

    return run(text)
