"""Joins: attribution, IP ranges, regions, listings, dictionaries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attribute_clicks(log: DataFrame) -> DataFrame:
    """(key, media_id, n_trac, n_hop) of (key, kind, ord, media_id): one aggregate; keys without a CLICK go, the last click counts."""
    of = lambda kind: F.col("kind") == kind
    media = F.max_by(F.when(of("CLICK"), F.col("media_id")), F.when(of("CLICK"), F.col("ord")))
    rows = log.groupBy("key").agg(media.alias("media_id"), F.count_if(of("TRAC")).alias("n_trac"), F.count_if(of("HOP")).alias("n_hop"), F.count_if(of("CLICK")).alias("n_click"))
    return rows.filter("n_click > 0").drop("n_click")


def route(media_id: Column, hop_media: int) -> Column:
    return F.when(media_id == hop_media, "HOP").otherwise("CLICK")


def ip_lookup(probes: DataFrame, blocks: DataFrame, ip_col: str = "ip", strict_end: bool = True, exclusive_start: bool = False, slot_bits: int = 16) -> DataFrame:
    """probes with code: of the block with the greatest start at or below the ip; null outside. One row for each probe row, repeated ones and null ips too.

    strict_end: the ip must lie within that block; else (compat) within the
    first start and last end. exclusive_start (compat): an ip that is a block's
    start belongs to the block before, but for the first one's. Blocks are a
    dimension of a few million rows at most: a block answers for the addresses
    up to the next start, and is listed under each slot of 2^slot_bits
    addresses that it answers in. Probes join on the slot and match one block.
    """
    slot = lambda c: F.floor(c / (1 << slot_bits)).cast("long")
    ordered = Window.orderBy("ip_start")
    own = blocks.groupBy("ip_start").agg(F.max_by(F.struct("ip_end", "code"), F.struct("ip_end", "code")).alias("b")).select("ip_start", "b.*")
    until = F.coalesce(F.lead("ip_start").over(ordered) - 1, F.greatest(F.max("ip_end").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.col("ip_start")))
    last = F.max("ip_end").over(Window.orderBy("ip_start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first = F.min("ip_start").over(Window.orderBy("ip_start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranges = own.select(F.col("ip_start").alias("_from"), until.alias("_to"), F.col("ip_end").alias("_end"), F.col("code").alias("_code"), first.alias("_first"), last.alias("_last"))
    if exclusive_start:
        ranges = ranges.withColumn("_to", F.col("_to") + (F.col("_to") < F.col("_last")).cast("int")).withColumn("_from", F.col("_from") + (F.col("_from") > F.col("_first")).cast("int"))
    spread = ranges.withColumn("_slot", F.explode(F.sequence(slot(F.col("_from")), slot(F.col("_to")))))
    ip = F.col(ip_col)
    rows = probes.withColumn("_probe_slot", slot(ip))
    hit = rows.join(spread, (F.col("_probe_slot") == F.col("_slot")) & (ip >= F.col("_from")) & (ip <= F.col("_to")), "left")
    code = F.when(ip <= F.col("_end"), F.col("_code")) if strict_end else F.when(ip <= F.col("_last"), F.col("_code"))
    return hit.select(*probes.columns, code.alias("code"))


def region_names(rows: DataFrame, areas: DataFrame, code_col: str = "code") -> DataFrame:
    """rows with area and province: the names of the code and of its province, null if unknown. areas: (code, name), codes as strings."""
    a = areas.select(F.col("code").alias("_c"), F.col("name").alias("area"))
    b = areas.select(F.col("code").alias("_p"), F.col("name").alias("province"))
    return rows.join(a, F.col(code_col) == F.col("_c"), "left").join(b, province(F.col(code_col)) == F.col("_p"), "left").drop("_c", "_p")


def ip_region(probes: DataFrame, blocks: DataFrame, areas: DataFrame, ip_col: str = "ip", **how) -> DataFrame:
    """probes with code, area and province: the address to its block, and the block's code to names."""
    return region_names(ip_lookup(probes, blocks, ip_col, **how), areas)


def province(code: Column) -> Column:
    return F.concat(F.substring(code, F.lit(1), F.length(code) - 2), F.lit("00"))


def region_income(rows: DataFrame, income: DataFrame, code_col: str = "code") -> DataFrame:
    """rows with income: of the code, else of its province, else 0. income: (code, income), a dimension of a few hundred rows."""
    a = income.select(F.col("code").alias("_c"), F.col("income").alias("_own"))
    b = income.select(F.col("code").alias("_p"), F.col("income").alias("_prov"))
    out = rows.join(a, F.col(code_col) == F.col("_c"), "left").join(b, province(F.col(code_col)) == F.col("_p"), "left")
    return out.withColumn("income", F.coalesce("_own", "_prov", F.lit(0.0))).drop("_c", "_p", "_own", "_prov")


def band(key: Column, table: dict[str, str]) -> Column:
    """A fixed lookup with N/A for the rest."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv]), key), F.lit("N/A"))


def listing_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(path, state) of two listings (path, length): same, size, only_left or only_right."""
    a, b = left.select("path", F.col("length").alias("a")), right.select("path", F.col("length").alias("b"))
    state = F.when(F.col("b").isNull(), "only_left").when(F.col("a").isNull(), "only_right").when(F.col("a") == F.col("b"), "same").otherwise("size")
    return a.join(b, "path", "full").select("path", state.alias("state"))


def overlay(old: DataFrame, new: DataFrame) -> DataFrame:
    """(word, freq): new entries win."""
    a, b = old.select("word", F.col("freq").alias("a")), new.select("word", F.col("freq").alias("b"))
    return a.join(b, "word", "full").select("word", F.coalesce("b", "a").alias("freq"))


def place_scan(rows: DataFrame, places: pd.DataFrame, text_col: str = "address", aliases: dict[str, str] | None = None) -> DataFrame:
    """rows with country, province and city found in a text; places: (country, province, city), a bounded dictionary. Longest names first."""
    home = places.set_index("province")["country"].to_dict()
    cities = sorted({(c, p, k) for k, p, c in places[["country", "province", "city"]].itertuples(index=False) if c}, key=lambda x: (-len(x[0]), x[0]))
    provinces = sorted({(p, k) for k, p in places[["country", "province"]].itertuples(index=False) if p}, key=lambda x: (-len(x[0]), x[0]))
    countries = sorted({k for k in places["country"] if k}, key=lambda x: (-len(x), x))
    text = F.col(text_col)
    for a, b in sorted((aliases or {}).items()):
        text = F.replace(text, F.lit(a), F.lit(b))
    out = rows.withColumn("_t", text)
    pick = lambda entries, n: F.coalesce(*[F.when(F.col("_t").contains(e[0]), F.lit(e[n])) for e in entries]) if entries else F.lit(None).cast("string")
    city, by_city, by_name = pick(cities, 0), pick(cities, 1), pick(provinces, 0)
    of_province = lambda p: F.coalesce(*[F.when(p == name, F.lit(k)) for name, k in sorted(home.items()) if name]) if any(home) else F.lit(None).cast("string")
    country = F.coalesce(of_province(F.coalesce(by_city, by_name)), pick([(k,) for k in countries], 0))
    return out.withColumn("country", country).withColumn("province", F.coalesce(by_city, by_name)).withColumn("city", city).drop("_t")
