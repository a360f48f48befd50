"""Binary records inside text logs: page views, clicks, tracking records, sessions.

A message is described by its fields: name -> (number, kind). Kinds are `long`,
`bool`, `double`, `string`, `bytes`, another description for a message in it,
or a list of one kind for a repeated field.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from clickloom.functions.udfs import rc4_array
from clickloom.sources.wire import Fields, arrow_type, from_base64, read_all, to_base64, written_all
from clickloom.sources.wire import read as read
from clickloom.sources.wire import written as written

#: The numbers of the fields that are read.
DISPLAY: Fields = {"media_id": (1, "long"), "display_ip": (2, "long"), "display_time": (3, "long"), "event_id": (4, "long"), "is_fallback": (6, "bool"), "channel_id": (14, "long")}
USER: Fields = {"xxid": (1, "bytes"), "muid": (2, "string"), "referer": (3, "string"), "user_agent": (4, "string"), "original_referer": (5, "string")}
CLICK_EX: Fields = {"user_info": (1, USER), "click_time": (2, "long"), "click_ip": (3, "long"), "click_url": (4, "string"), "click_hash": (5, "long")}
CLICK: Fields = {"display_info": (2, DISPLAY), "frontend_spent": (5, "long"), "crc32": (6, "long"), "user_attr_list": (7, ["long"]), "is_debug": (8, "bool"), "uctrac_clk": (9, "string")}
PAGE_VIEW: Fields = {"display_info": (2, DISPLAY), "user_info": (3, USER), "render_time": (5, "long")}
TRACKING: Fields = {
    "click_id": (1, "string"), "muid": (2, "string"), "xxid": (3, "string"), "utrac_eid": (4, "long"), "is_landing": (5, "bool"), "is_from_ad": (6, "bool"), "ip": (7, "long"), "time": (8, "long"),
    "char_code": (9, "string"), "resolution": (10, "string"), "color_depth": (11, "string"), "page_title": (12, "string"), "page_url": (13, "string"), "page_host": (14, "string"), "page_path": (15, "string"), "click_hash": (16, "string"),
}


def _unpacked(texts: pa.Array, fields: Fields, key: bytes | None) -> pa.StructArray:
    data = from_base64(texts)
    return read_all(rc4_array(data, key) if key else data, fields)


def message(text: Column, fields: Fields, key: bytes | None = None) -> Column:
    """The struct in URL-safe base64, enciphered if a key is given; null if it is malformed."""

    @F.arrow_udf(from_arrow_type(arrow_type(fields)))
    def run(values: pa.Array) -> pa.Array:
        return _unpacked(values, fields, key)

    return run(text)


def packed(record: Column, fields: Fields, key: bytes | None = None) -> Column:
    """A struct as URL-safe base64 of its wire form."""

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        data = written_all(values, fields)
        return to_base64(rc4_array(data, key) if key else data)

    return run(record)


def page_view(text: Column) -> Column:
    return message(text, PAGE_VIEW)


def click_ex(text: Column) -> Column:
    return message(text, CLICK_EX)


def click(text: Column, key: bytes) -> Column:
    return message(text, CLICK, key)


def tracking_record(text: Column) -> Column:
    return message(text, TRACKING)


def tracking_text(record: Column) -> Column:
    return packed(record, TRACKING)


def _decoded_steps(values: pa.ListArray, kind: pa.ListType, key: bytes) -> pa.ListArray:
    """All steps of a batch side by side; those that are null are left out."""
    sizes = pc.list_value_length(values).fill_null(0).to_numpy(zero_copy_only=False)
    steps = values.flatten()
    present = steps.is_valid().to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(values)), sizes)[present]
    columns = dict(zip([f.name for f in steps.type], steps.filter(pa.array(present)).flatten(), strict=True))
    clicks = pc.equal(columns["cate"], "click").fill_null(False)
    ex, obj = (pc.if_else(clicks, columns[name].cast(pa.string()), pa.scalar(None, pa.string())) for name in ("clkex", "clkobj"))
    decoded = [columns["cate"].cast(pa.string()), _unpacked(ex, CLICK_EX, None), _unpacked(obj, CLICK, key)]
    places = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(values)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(places), pa.StructArray.from_arrays(decoded, fields=list(kind.value_type)), type=kind, mask=values.is_null())


def session_paths(paths: Column, key: bytes) -> Column:
    """array<struct<cate, clkex, clkobj>> with the two texts of clicks decoded; of other steps they are null. No shuffle: a session is one value."""
    kind = pa.list_(pa.struct([("cate", pa.string()), ("clkex", arrow_type(CLICK_EX)), ("clkobj", arrow_type(CLICK))]))

    @F.arrow_udf(from_arrow_type(kind))
    def run(values: pa.Array) -> pa.Array:
        return _decoded_steps(values, kind, key)

    return run(paths)
