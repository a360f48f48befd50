"""Scalar text, URL, number and hash functions: Column -> Column, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _quoted(key: str) -> str:
    return "\\Q" + key.replace("\\E", "") + "\\E"


def query_part(url: Column) -> Column:
    """What follows the first ?; the whole string if there is none."""
    return F.when(F.instr(url, "?") > 0, F.substring(url, F.instr(url, "?") + 1, F.length(url))).otherwise(url)


def query_map(query: Column) -> Column:
    """Decoded arguments of a bare query string: map<string, array<string>>; blank values are dropped, ; separates like &."""
    pairs = F.filter(F.split(query, "[&;]"), lambda p: F.regexp_like(p, F.lit("^[^=]+=.+")))
    decoded = F.transform(pairs, lambda p: F.struct(F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"), F.try_url_decode(F.regexp_replace(p, "^[^=]*=", "")).alias("v")))
    keys = F.array_distinct(F.filter(F.transform(decoded, lambda x: x["k"]), lambda k: k.isNotNull()))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(decoded, lambda x: x["k"] == k), lambda x: x["v"])))


def url_arg(url: Column, key: str) -> Column:
    """First value of an argument, decoded; '' if absent."""
    raw = F.regexp_extract(url, r"[?&]" + _quoted(key) + r"=([^&#]*)", 1)
    return F.coalesce(F.try_url_decode(raw), F.lit(""))


def query_arg(query: Column, key: str) -> Column:
    return url_arg(F.concat(F.lit("?"), query), key)


def tracking_arg(request: Column, key: str, decode: bool = False) -> Column:
    """Last value of a tracking parameter; + isn't a blank here."""
    raw = F.regexp_extract(request, r"^.*[?&]" + _quoted(key) + r"=([^&\s]*)", 1)
    return F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))) if decode else raw


def click_key(query: Column) -> tuple[Column, Column]:
    """(key, is_landing): the first event id wins; the plain one marks a landing."""
    first, plain = query_arg(query, "uctrac_eid_1"), query_arg(query, "uctrac_eid")
    key = F.coalesce(F.nullif(first, F.lit("")), F.nullif(plain, F.lit("")))
    return key, (first == "") & (plain != "")


def hop_key(referer: Column) -> Column:
    """The click hash that a hop's referer carries; null if it carries none."""
    arguments = query_part(referer)
    return F.coalesce(*[F.nullif(query_arg(arguments, k), F.lit("")) for k in ("uctrac_clk_1", "uctrac_clk")])


def all_true(values: Column) -> Column:
    """Whether all of an array's values are true; true for none."""
    return F.forall(values, lambda v: F.coalesce(v, F.lit(False)))


def first_truthy(values: Column) -> Column:
    """The first element of an array of strings that isn't null or empty; null if there is none."""
    return F.get(F.filter(values, lambda v: F.coalesce(v != "", F.lit(False))), F.lit(0))


def cookie(cookies: Column, name: str, trim: int = 0) -> Column:
    """A cookie's value, less `trim` characters at its end."""
    value = F.regexp_extract(cookies, r"(?:^|[;\s])" + _quoted(name) + r"=([^;\s]*)", 1)
    return F.substring(value, F.lit(1), F.greatest(F.lit(0), F.length(value) - trim)) if trim else value


def _scraped(text: Column, key: str, value: str) -> Column:
    # key and value each with an optional quote, which may be escaped; the pair begins and ends at a word boundary
    quote = r"(?:\\?['\"])?"
    return F.nullif(F.regexp_extract(text, r"(?s)\b" + quote + _quoted(key) + quote + r"\s*[:=]\s*" + quote + "(" + value + ")" + quote + r"\b", 1), F.lit(""))


def scrape(text: Column, key: str) -> Column:
    """The value of key in a=b, 'a':'b' or \\"a\\":\\"b\\" notation, up to a quote, blank or semicolon; null if there is none."""
    return _scraped(text, key, "[^'\"; ]+")


def scrape_number(text: Column, key: str) -> Column:
    """The same of digits and points only, as text."""
    return _scraped(text, key, "[0-9.]+")


def jsonp(payload: Column) -> Column:
    """The JSON inside callback(...)."""
    return F.regexp_extract(payload, r"(?s)^[^(]*\((.*)\)[^)]*$", 1)


def jsonp_after(page: Column, lead: str) -> Column:
    """What stands in the first parentheses after lead, up to the first closing one; null if there is none."""
    rest = F.when(F.instr(page, lead) > 0, F.substring(page, F.instr(page, lead), F.length(page)))
    return F.nullif(F.regexp_extract(rest, r"(?s)^[^(]+\(([^)]*)\)", 1), F.lit(""))


def relaxed_json(text: Column, schema: str) -> Column:
    """JSON whose object keys may go without quotes; null if malformed."""
    return F.from_json(text, schema, {"allowUnquotedFieldNames": "true"})


def ngrams(text: Column, longest: int = 0) -> Column:
    """Character n-grams of blank-separated tokens: tokens of up to 2 characters whole, of others all of 2 to longest (0: any length).

    Without a limit a token of n characters has n(n-1)/2 of them.
    """

    def of(token: Column) -> Column:
        upto = F.least(F.lit(longest), F.length(token)) if longest else F.length(token)
        sizes = F.sequence(F.lit(2), upto)
        grams = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length(token) - n + 1), lambda i: F.substring(token, i, n))))
        return F.when(F.length(token) <= 2, F.array(token)).otherwise(F.when(upto >= 2, grams).otherwise(F.array().cast("array<string>")))

    tokens = F.filter(F.split(text, "\\s+"), lambda t: t != "")
    return F.flatten(F.transform(tokens, of))


def is_cjk(text: Column) -> Column:
    """True unless every character is within 0x01-0x7e; so true for ''."""
    return ~F.regexp_like(text, F.lit("^[\\x01-\\x7e]+$"))


def safe_int(text: Column, default: int = -1) -> Column:
    return F.coalesce(F.when(F.trim(text).rlike("^[+-]?[0-9]+$"), F.trim(text).try_cast("bigint")), F.lit(default).cast("long"))


def ip_to_int(ip: Column, failed: int = 0) -> Column:
    """An IPv4 address as an unsigned number; `failed` for anything else.

    One to four parts, the last of which fills the bytes that are left; each is
    decimal, octal with a leading 0, or hexadecimal with a leading 0x.
    """

    def number(p: Column) -> Column:
        hexadecimal, octal = p.rlike("^0[xX][0-9a-fA-F]{1,8}$"), p.rlike("^0[0-7]{1,11}$")
        return F.when(hexadecimal, F.conv(F.substring(p, 3, 8), 16, 10)).when(octal, F.conv(p, 8, 10)).when(p.rlike("^(0|[1-9][0-9]{0,9})$"), p).try_cast("bigint")

    parts = F.transform(F.split(ip, "\\."), number)
    n = F.size(parts)
    last = F.element_at(parts, -1)
    leading = F.slice(parts, F.lit(1), n - 1)
    good = ip.isNotNull() & n.between(1, 4) & F.forall(parts, lambda p: p.isNotNull())
    high = F.aggregate(leading, F.lit(0).cast("long"), lambda a, p: a * 256 + p)
    room = F.element_at(F.array(*[F.lit(1 << 8 * k) for k in (4, 3, 2, 1)]), F.least(n, F.lit(4)))
    fits = F.forall(leading, lambda p: p <= 255) & (last < room)
    return F.when(good, F.when(fits, high * room + last).otherwise(F.lit(failed).cast("long"))).otherwise(F.lit(failed).cast("long"))


def java_hash(text: Column) -> Column:
    """Signed 32-bit hash with base 31 over characters."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    raw = F.aggregate(chars, F.lit(0).cast("long"), lambda a, c: F.pmod(a * 31 + F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("bigint"), F.lit(4294967296)))
    return F.when(raw >= 2147483648, raw - 4294967296).otherwise(raw)


def wrap(value: Column, n_bytes: int) -> Column:
    """Two's complement of so many bytes."""
    size = 1 << (8 * n_bytes)
    low = F.pmod(value, F.lit(size))
    return F.when(low >= size // 2, low - size).otherwise(low)


def hex_key(value: Column) -> Column:
    return F.format_string("%016x", value)


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(c)), 2, "0") for c in (r, g, b)])


def parent_path(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path, "/+$", ""), "^(.*)/[^/]*$", 1)


def transliterated(text: Column, table: dict[str, str]) -> Column:
    """Each character's reading; others pass through."""
    m = F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv])
    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(m, c), c)), "")


def elapsed_seconds(text: Column) -> Column:
    """[[dd-]hh:]mm:ss as seconds; null otherwise."""
    pattern = r"^(?:(?:([0-9]+)-)?([0-9]{1,2}):)?([0-9]{1,2}):([0-9]{1,2})$"
    part = lambda n: F.coalesce(F.nullif(F.regexp_extract(text, pattern, n), F.lit("")).try_cast("bigint"), F.lit(0))
    return F.when(text.rlike(pattern), part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4))


def sql_literal(value: Column, kind: str) -> Column:
    """A value as SQL text: booleans 0 or 1, strings quoted with quotes doubled, null as NULL."""
    shown = {"boolean": lambda: value.cast("int").cast("string"), "string": lambda: F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))}.get(kind, lambda: value.cast("string"))()
    return F.coalesce(shown, F.lit("NULL"))
