"""A packed address database as address blocks.

The file holds an 8-byte header (offsets of the first and the last index entry)
and index entries of 7 bytes: a block's first address and a 3-byte offset. There
stand the block's last address and two texts, country and area; a byte 1 says
that both are elsewhere, a byte 2 that the text is. Offsets are 3 bytes, numbers
little-endian, texts end with a zero byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def blocks_of(data: bytes, charset: str = "gbk") -> Iterator[tuple[int, int, str, str]]:
    """(first address, last address, country, area) of each index entry."""

    def number(at: int, size: int) -> int:
        return int.from_bytes(data[at : at + size], "little")

    def text(at: int) -> tuple[str, int]:
        """The text at a place, which may point elsewhere, and where the next one follows."""
        if data[at] in (1, 2):
            target = number(at + 1, 3)
            return text(target)[0] if target else "", at + 4
        end = data.index(0, at)
        return data[at:end].decode(charset, errors="replace"), end + 1

    first, last = number(0, 4), number(4, 4)
    for entry in range(first, last + 1, 7):
        at = number(entry + 4, 3)
        end = number(at, 4)
        place = at + 4
        if data[place] == 1:
            place = number(place + 1, 3)
        country, rest = text(place)
        yield number(entry, 4), end, country, text(rest)[0]


def ip_database(spark: SparkSession, path: str, charset: str = "gbk") -> DataFrame:
    """(ip_start, ip_end, country, area) of packed address files; a file is one task's."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = list(blocks_of(data, charset))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["ip_start", "ip_end", "country", "area"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(of, "ip_start long, ip_end long, country string, area string")
