import base64
import random
import struct
import time
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from clickloom.functions.udfs import rc4, to_url_base64, wire_encode
from clickloom.operators import enrich, features, flow, models, scoring
from clickloom.plans import catalogue
from clickloom.sources import images, ipdb, logs, records, sinks, wire


def samples(spark, groups):
    rows = [(n, r, dict.fromkeys(f, 1.0)) for n, (count, r, f) in enumerate(groups) for _ in range(count)]
    return spark.createDataFrame(rows, "id long, result double, features map<string,double>")


@pytest.fixture(scope="module")
def f884(spark):
    return samples(spark, [(199, 0.1, "acd"), (220, 0.5, "abe"), (201, 0.2, "cf"), (264, 0.4, "bcg")]).cache()


def test_stats(spark):
    s = samples(spark, [(22, 0.3, "a"), (40, 0.6, "ab"), (90, 0.9, "c"), (90, 0.4, "ab")])
    got = {r["feature"]: (round(r["total"], 6), r["n"], round(r["lift"], 2)) for r in features.lifts(s).collect()}
    assert got == {"a": (66.6, 152, 0.72), "b": (60.0, 130, 0.76), "c": (81.0, 90, 1.48)}
    assert features.restrict(s, features.top_features(s)).count() == 242


def test_screen(f884):
    assert sorted(r["feature"] for r in features.univariate_screen(f884).collect()) == list("bcdefg")


def test_constant(f884):
    assert models.train("const", f884) == {"Average": 0.02}


def near(got, expected, tol=0.015):
    assert set(expected) <= set(got)
    for k, v in expected.items():
        assert abs(got[k] - v) < tol, (k, got[k], v)


def test_logit(spark, f884):
    kept = features.restrict(f884, features.univariate_screen(f884))
    w = models.train("logit", kept)
    near(w, {"b": 0.98, "c": -0.41, "d": -0.81, "(Intercept)": -0.98})
    assert set(w) == {"b", "c", "d", "(Intercept)"}


def test_pca(f884):
    w = models.train("pca", features.restrict(f884, features.univariate_screen(f884)))
    near(w, {"b": 0.57, "c": -0.38, "d": -0.41, "e": 0.38, "f": -0.41, "g": 0.34, "(Intercept)": -0.95})


def test_l2(f884):
    near(models.train("lg", f884), {"a": -0.38, "b": 0.51, "c": -0.71, "d": -0.67, "e": 0.29, "f": -0.25, "g": 0.22, "(Intercept)": -0.42})


def test_unknown_model(f884):
    with pytest.raises(ValueError, match="no model"):
        models.train("bayes", f884)


def test_universal_feature_gains_nothing(spark):
    s = samples(spark, [(3, 1.0, "ab"), (3, 0.0, "a")])
    assert {r["feature"] for r in features.info_gain(s).collect()} == {"b"}


def test_auc(spark):
    rows = [(n, float(n % 3 == 0), (n * 37 % 50) / 50) for n in range(200)]
    pairs = spark.createDataFrame(rows, "id long, actual double, predicted double")
    got = scoring.auc(pairs).first()["auc"]
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    pos, neg = sum(r[1] for r in rows), sum(1 - r[1] for r in rows)
    x = y = px = py = area = 0.0
    for _, a, _ in order:
        x, y = x + (1 - a) / neg, y + a / pos
        area += (x - px) * (y + py) / 2
        px, py = x, y
    assert abs(got - area) < 1e-9


def test_attribution(spark):
    log = spark.createDataFrame([(1, "CLICK", 1, 10), (1, "CLICK", 2, 11), (1, "TRAC", 1, None), (2, "HOP", 1, None)], "key long, kind string, ord long, media_id long")
    assert [tuple(r) for r in enrich.attribute_clicks(log).collect()] == [(1, 11, 1, 0)]


@pytest.mark.parametrize("strict", [True, False])
def test_ip_lookup(spark, strict):
    blocks = [(i * 700, i * 700 + 299, str(i)) for i in (1, 2, 9, 40)]
    probes = [(n, n * 53) for n in range(700)]
    probes += [(900, None), (901, 7000), (901, 7000), (None, 1500)]
    got = enrich.ip_lookup(spark.createDataFrame(probes, "id long, ip long"), spark.createDataFrame(blocks, "ip_start long, ip_end long, code string"), strict_end=strict, slot_bits=8)
    expected = []
    for n, ip in probes:
        below = [b for b in blocks if ip is not None and b[0] <= ip]
        inside = below and (ip <= below[-1][1] if strict else ip <= blocks[-1][1])
        expected.append((n, ip, below[-1][2] if inside else None))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)
    assert "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_ip_exclusive_start(spark):
    blocks = spark.createDataFrame([(10, 19, "a"), (20, 29, "b"), (40, 49, "c")], "ip_start long, ip_end long, code string")
    probes = spark.createDataFrame([(n,) for n in (9, 10, 11, 20, 21, 40, 41, 49, 50)], "ip long")
    got = {r["ip"]: r["code"] for r in enrich.ip_lookup(probes, blocks, strict_end=False, exclusive_start=True, slot_bits=3).collect()}
    assert got == {9: None, 10: "a", 11: "a", 20: "a", 21: "b", 40: "b", 41: "c", 49: "c", 50: None}


def test_ip_database(spark, tmp_path):
    """A packed file with a plain entry, one that is elsewhere altogether, and one whose two texts are."""
    body, entries = bytearray(8), []
    add = lambda data: (len(body), body.extend(data))[0]
    plain = add((99).to_bytes(4, "little") + "中国".encode("gbk") + b"\0" + b"net\0")
    entries.append((50, plain))
    entries.append((100, add((199).to_bytes(4, "little") + b"\1" + (plain + 4).to_bytes(3, "little"))))
    entries.append((200, add((299).to_bytes(4, "little") + b"\2" + (plain + 4).to_bytes(3, "little") + b"\2" + (plain + 9).to_bytes(3, "little"))))
    first = len(body)
    for start, at in entries:
        body += start.to_bytes(4, "little") + at.to_bytes(3, "little")
    body[:8] = first.to_bytes(4, "little") + (len(body) - 7).to_bytes(4, "little")
    (tmp_path / "ip.dat").write_bytes(bytes(body))
    got = [tuple(r) for r in ipdb.ip_database(spark, str(tmp_path / "ip.dat")).collect()]
    assert got == [(50, 99, "中国", "net"), (100, 199, "中国", "net"), (200, 299, "中国", "net")]


def test_places_of_several_countries(spark):
    places = pd.DataFrame([("China", "Hubei", "Wuhan"), ("Japan", "Kanto", "Tokyo")], columns=["country", "province", "city"])
    got = enrich.place_scan(spark.createDataFrame([("in Tokyo",)], "address string"), places).first()
    assert (got["country"], got["province"], got["city"]) == ("Japan", "Kanto", "Tokyo")


@pytest.mark.parametrize("kind", ["long", "double", "string", "timestamp_ntz"])
def test_numbered(spark, kind):
    base = {"long": lambda n: n * 7919 % 1000, "double": lambda n: (n * 37 % 1000) / 8, "string": lambda n: "shared-" + chr(97 + n % 26) + str(n * 31 % 997), "timestamp_ntz": lambda n: datetime(2020, 1, 1) + timedelta(hours=n * 613 % 1000)}[kind]
    rows = spark.createDataFrame([(base(n),) for n in range(1000)] + [(None,)], f"k {kind}")
    got = sorted((r["n"], r["k"]) for r in flow.numbered(rows, "k", parts=7).collect())
    assert [n for n, _ in got] == list(range(1001)) and got[0][1] is None
    assert [k for _, k in got[1:]] == sorted(k for _, k in got[1:])


@pytest.mark.parametrize(("rows", "n"), [(23, 7), (3, 5), (0, 3), (21, 7)])
def test_row_blocks(spark, rows, n):
    got = [r["block"] for r in flow.row_blocks(spark.range(rows), "id", n).orderBy("id").collect()]
    assert got == [k for k in range(n) for _ in range(rows // n + (k < rows % n))]


def test_waiting_bucket(spark):
    rows = [(n, "k", datetime(2020, 1, 1) + timedelta(seconds=n)) for n in (0.0, 0.5, 1.0, 1.5, 60.0)]
    got = flow.waiting_bucket(spark.createDataFrame(rows, "id double, k string, ts timestamp_ntz"), "k", "ts", "id", 2, 4)
    # one token to begin with, then one each two seconds
    assert [(r["admitted"] - datetime(2020, 1, 1)).total_seconds() for r in got.orderBy("id").collect()] == [0, 2, 4, 6, 60]


def test_wide_fits(spark):
    """As many features as the screen lets through: 399, two of them aliased."""
    r = np.random.default_rng(4)
    x = r.random((1500, 399)) < 0.05
    x[:, 398] = x[:, 0]
    weights = r.normal(size=399) * 0.3
    y = np.clip(0.3 + 0.2 * (x @ weights), 0.02, 0.98)
    rows = [(n, float(y[n]), {f"f{j:03d}": 1.0 for j in np.flatnonzero(x[n]).tolist()}) for n in range(1500)]
    s = spark.createDataFrame(rows, "id long, result double, features map<string,double>").cache()
    started = time.perf_counter()
    w = models.train("old", s)
    assert time.perf_counter() - started < 60
    assert "f398" not in w and len(w) == 399
    full = np.hstack([x[:, :398].astype(float), np.ones((1500, 1))])
    want = np.linalg.lstsq(full, np.minimum(y, 1), rcond=None)[0]
    assert max(abs(w[f"f{j:03d}"] - want[j]) for j in range(398)) < 1e-6 and abs(w["(Intercept)"] - want[-1]) < 1e-6
    g, n = models.gram(models.design(s, [f"f{j:03d}" for j in range(398)]), 398)
    assert n == 1500 and np.abs(g - full.T @ full).max() < 1e-9


def test_weighted_lines(spark):
    s = samples(spark, [(1, 0.25, "ba"), (1, 1.0, "c"), (1, 0.0, "")])
    got = [(r["line"], r["weight"]) for r in features.weighted_lines(s, "id", features.dictionary(s)).collect()]
    assert got[0] == ("1", 1e-7)
    assert sorted(got[1:]) == [("0 ", 1e8), ("0 1:1.0 2:1.0", 7.5e7), ("1 1:1.0 2:1.0", 2.5e7), ("1 3:1.0", 1e8)]


def test_records(spark):
    message = {"user_info": {"xxid": b"\x00\xff", "muid": "m", "referer": "r", "user_agent": None, "original_referer": None}, "click_time": 5, "click_ip": 0, "click_url": "é", "click_hash": -2}
    assert records.read(records.written(message, records.CLICK_EX), records.CLICK_EX) == message
    rows = spark.createDataFrame([("!!",), ("",), (None,), ("AAAA",)], "m string").select(records.click_ex(F.col("m")).alias("x")).collect()
    assert [r["x"] is None for r in rows] == [False, False, True, True]  # what isn't of the alphabet is skipped


_INNER = {"a": (1, "long"), "b": (2, "string"), "c": (3, "double"), "d": (4, ["string"])}
_OUTER = {"n": (1, "long"), "s": (2, "string"), "y": (3, "bytes"), "t": (4, "bool"), "m": (5, _INNER), "ns": (6, ["long"]), "ms": (7, [_INNER])}


def _wire(rng, fields):
    """A message with some fields twice, of other types, unknown, or cut short."""
    out = b""
    for _ in range(rng.randrange(6)):
        number, kind = fields[rng.choice(list(fields))]
        single = kind[0] if isinstance(kind, list) else kind
        number = 99 if rng.random() < 0.02 else number
        single = "string" if rng.random() < 0.02 else single
        if single == "double":
            out += wire_encode([(number, 0)])[:-1].replace(b"\x18", b"\x19") + rng.randbytes(8)
        elif isinstance(single, dict):
            out += wire_encode([(number, _wire(rng, single))])
        else:
            out += wire_encode([(number, rng.choice([0, 127, 128, 2**63, 2**64 - 1, 2**64 + 5]) if single in ("long", "bool") else rng.choice([b"", b"\xff\xfe", "é中".encode() * 9]))])
    return out[: rng.randrange(len(out) + 1)] if rng.random() < 0.05 else out


@pytest.mark.parametrize("few", [0, wire.FEW, 10**9])
def test_records_in_columns(few):
    rng = random.Random(few)
    values = [None if rng.random() < 0.05 else _wire(rng, _OUTER) for _ in range(500)]

    def one(v):
        try:
            return None if v is None else wire.read(v, _OUTER)
        except (ValueError, struct.error):
            return None

    want = [one(v) for v in values]
    got = wire.read_all(pa.array([b"x", *values], pa.binary()).slice(1), _OUTER, few)
    got.validate(full=True)
    assert 10 < got.null_count < 250 and repr(got.to_pylist()) == repr(want)
    plain = {k: v for k, v in _OUTER.items() if k not in ("m", "ms")}
    rows = pa.array([r and {k: r[k] for k in plain} for r in want], wire.arrow_type(plain))
    assert wire.written_all(rows, plain).to_pylist() == [None if r is None else wire.written(r, plain) for r in rows.to_pylist()]


def test_records_cost_no_steps_for_each(monkeypatch):
    message = {"user_info": {"xxid": b"x", "muid": "m", "referer": "r", "user_agent": None, "original_referer": None}, "click_time": 5, "click_ip": 0, "click_url": "é", "click_hash": -2}
    rows = pa.array([message] * 1000, wire.arrow_type(records.CLICK_EX))
    calls = []
    for name in ("read", "written", "wire_fields", "wire_encode"):
        monkeypatch.setattr(wire, name, lambda *a, f=getattr(wire, name): calls.append(1) or f(*a))
    assert wire.read_all(wire.from_base64(wire.to_base64(wire.written_all(rows, records.CLICK_EX))), records.CLICK_EX).equals(rows)
    assert len(calls) <= 10  # the tags of the fields


@pytest.mark.parametrize("piece", [1, 3000, 1 << 21])
def test_records_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(wire, "PIECE", piece)
    rows = pa.array([{"user_attr_list": list(range(k)), "uctrac_clk": "u"} if k % 7 else None for k in range(200)], pa.struct([("user_attr_list", pa.list_(pa.int64())), ("uctrac_clk", pa.string())]))
    texts = wire.written_all(rows, records.CLICK)
    assert texts.to_pylist() == [r and wire.written(r, records.CLICK) for r in rows.to_pylist()]
    sizes, longest = [], wire._parsed
    monkeypatch.setattr(wire, "_parsed", lambda data, starts, ends, *a: sizes.append((len(starts), int((ends - starts).sum()))) or longest(data, starts, ends, *a))
    got = wire.read_all(texts, records.CLICK)
    assert got.field("user_attr_list").filter(got.is_valid()).to_pylist() == [list(range(k)) for k in range(200) if k % 7] and got.null_count == 29
    assert piece > 3000 or max(n for n, _ in sizes) < 60
    assert wire.read_all(texts.slice(0, 0), records.CLICK).to_pylist() == [] and wire.written_all(rows.slice(0, 0), records.CLICK).to_pylist() == []


def test_tracking_costs_no_steps_for_each(monkeypatch):
    rows = pa.array([{n: f"{n}{k}" if kind == "string" else k % 2 == 1 if kind == "bool" else k - 50 for n, (_, kind) in records.TRACKING.items()} if k % 9 else None for k in range(100)], wire.arrow_type(records.TRACKING))
    texts = wire.to_base64(wire.written_all(rows, records.TRACKING))
    assert texts.to_pylist() == [None if r is None else to_url_base64(wire.written(r, records.TRACKING)) for r in rows.to_pylist()]
    monkeypatch.setattr(wire, "read", None)
    assert wire.read_all(wire.from_base64(texts), records.TRACKING).equals(rows)


@pytest.mark.parametrize("name", ["tracking_roundtrip", "click_messages", "session_paths"])
def test_messages_of_one_row_group_are_dealt_out(spark, tmp_path, name):
    keys = list(range(20_000)) + [7, 7, None]
    pq.write_table(pa.table({"c_custkey": pa.array(keys, pa.int64()), "c_name": pa.array([f"Customer#{k}" for k in keys])}), tmp_path / "customer.parquet")
    least = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    spark.conf.set(least, "1k")  # so that a small table counts as a large one
    try:
        got = catalogue.queries()[name](spark, str(tmp_path)).select("c_custkey", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset(least)
    assert sorted(r["c_custkey"] for r in got if r["c_custkey"] is not None) == sorted(keys[:-1]) and len(got) == len(keys)
    rows = Counter(r["task"] for r in got)
    assert len(rows) > 1 and max(rows.values()) <= len(keys) / 2


def test_sessions_side_by_side(spark, monkeypatch):
    ex = {"user_info": None, "click_time": 5, "click_ip": 0, "click_url": "é", "click_hash": -2}
    obj = {"display_info": None, "frontend_spent": 1, "crc32": 2, "user_attr_list": [3, 4], "is_debug": None, "uctrac_clk": "u"}
    a, b = to_url_base64(records.written(ex, records.CLICK_EX)), to_url_base64(rc4(records.written(obj, records.CLICK), b"k"))
    click, other = {"cate": "click", "clkex": a, "clkobj": b}, {"cate": "pv", "clkex": a, "clkobj": None}
    sessions = [[other, click], None, [], [click, None, {"cate": "click", "clkex": a[:9], "clkobj": None}], [{"cate": None, "clkex": a, "clkobj": b}, click]]
    done, none = {"cate": "click", "clkex": ex, "clkobj": obj}, {"clkex": None, "clkobj": None}
    want = [[{"cate": "pv", **none}, done], None, [], [done, {"cate": "click", **none}], [{"cate": None, **none}, done]]
    rows = spark.createDataFrame([(n, s) for n, s in enumerate(sessions * 20)], "n int, p array<struct<cate string, clkex string, clkobj string>>").coalesce(1)
    got = rows.select("n", records.session_paths(F.col("p"), b"k").alias("p")).orderBy("n").collect()
    assert [r.asDict(recursive=True)["p"] for r in got] == want * 20
    monkeypatch.setattr(wire, "read", None)
    columns = pa.array(([[other, click]] * 50), pa.list_(pa.struct([(c, pa.string()) for c in ("cate", "clkex", "clkobj")])))
    kind = pa.list_(pa.struct([("cate", pa.string()), ("clkex", wire.arrow_type(records.CLICK_EX)), ("clkobj", wire.arrow_type(records.CLICK))]))
    assert records._decoded_steps(columns, kind, b"k").slice(3, 2).to_pylist() == [want[0]] * 2


def test_a_number_too_large_does_not_end_the_job(spark):
    text = base64.urlsafe_b64encode(wire_encode([(2, 2**64 + 5), (5, 2**65 - 1)])).decode()
    row = spark.createDataFrame([(text,)], "m string").select(records.click_ex(F.col("m")).alias("x")).first()["x"]
    assert (row["click_time"], row["click_hash"]) == (5, -1)


def test_region_income(spark):
    income = spark.createDataFrame([("0100", 5.0), ("0203", 7.0)], "code string, income double")
    rows = spark.createDataFrame([("0101",), ("0203",), ("0999",)], "code string")
    assert {r["code"]: r["income"] for r in enrich.region_income(rows, income).collect()} == {"0101": 5.0, "0203": 7.0, "0999": 0.0}


def test_last_points_and_alerts(spark):
    rows = [("a", 1, 5.0), ("a", 2, None), ("a", 3, 6.0), ("a", 4, 0.0), ("b", 1, None)]
    s = spark.createDataFrame(rows, "series string, ts long, value double")
    assert [(r["ts"], r["value"]) for r in flow.last_points(s, 2).orderBy("place").collect()] == [(3, 6.0), (2, None)]
    assert {r["series"]: r["alert"] for r in flow.alerts(s, 1, 5.5).collect()} == {"a": True, "b": True}


def test_token_bucket(spark):
    rows = [(n, "k", (datetime(2020, 1, 1) + timedelta(seconds=n))) for n in range(10)]
    got = flow.token_bucket(spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz"), "k", "ts", "id", 2, 4)
    assert sorted(r["id"] for r in got.collect()) == [0, 1, 2, 4, 6, 8]


def test_places(spark):
    places = pd.DataFrame([("China", "Hubei", "Wuhan"), ("Japan", "", "")], columns=["country", "province", "city"])
    rows = spark.createDataFrame([("x College",), ("Hubei road",), ("Japan",), ("nowhere",)], "address string")
    got = {r["address"]: (r["country"], r["province"], r["city"]) for r in enrich.place_scan(rows, places, aliases={"x College": "Wuhan"}).collect()}
    assert got == {"x College": ("China", "Hubei", "Wuhan"), "Hubei road": ("China", "Hubei", None), "Japan": ("Japan", None, None), "nowhere": (None, None, None)}


def test_logs(spark):
    line = '1.2.3.4 - - [01/Feb/2012:03:04:05 +0800] "GET /t?uh=h1&up=%E4%B8%AD HTTP/1.1" 200 1 "http://ref/" "agent" "-" "-" "MUID=m1; YYID=y1"'
    # parts: ip and time, request, status, referer, blank, agent, blank, -, blank, -
    row = logs.tracking_log(spark.createDataFrame([(line,), ("short",)], "value string")).first()
    assert (row["ip"], row["referer"], row["uh"], row["up"]) == ("1.2.3.4", "http://ref/", "h1", "中")
    coef = spark.createDataFrame([('"Estimate"',), ('"a" 1.5',), ('"b" NA',)], "value string")
    assert [tuple(r) for r in logs.coefficients(coef).collect()] == [("a", 1.5)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "o'x", True)], "a int, b string, c boolean")
    assert sinks.insert_sql(rows, "t", ["a", "b", "c", "zz"]).first()["sql"] == "INSERT INTO t (a, b, c) VALUES (1, 'o''x', 1);"
    s = samples(spark, [(2, 1.0, "a")])
    sinks.write_dense(s, ["a", "b"], str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "m"), sep=" ", header=True).columns == ["input_0", "input_1", "result"]
    sinks.write_libsvm(models.design(s, ["a", "b"]).withColumn("label", F.lit(1)), str(tmp_path / "l"))
    assert spark.read.format("libsvm").option("numFeatures", "2").load(str(tmp_path / "l")).count() == 2


def test_small_sinks_and_sources(spark, tmp_path):
    weights = {"a": 0.5, "(Intercept)": -1.0}
    models.save(spark.range(1), weights, str(tmp_path / "model"))
    assert models.load(spark, str(tmp_path / "model")) == weights
    lines = [r["line"] for r in sinks.weight_report(models.as_frame(spark.range(1), weights)).collect()]
    assert lines == [f"{'a':30s} : +0.500000000", f"{'(Intercept)':30s} : -1.000000000"]
    s = spark.createDataFrame([(1, 0.5, {"b": 2.0, "a": 1.5, "c": 0.9})], "id long, result double, features map<string,double>")
    assert sinks.named_sparse(s).first()["line"] == "0.5 a:1.5 b:2.0"
    assert sinks.validation_lines(spark.createDataFrame([(1.0, 0.25)], "actual double, predicted double")).first()["line"] == "1.0:b,0.25:m"
    x, y = sinks.split_target(spark.createDataFrame([(1, 2, 3)], "a int, b int, c int"))
    assert (x.columns, y.columns) == (["a", "b"], ["c"])
    spark.sql("DROP TABLE IF EXISTS kept_once")
    sinks.create_table(spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, v string"), "kept_once", unique=["k"], partition=["k"])
    try:
        assert sorted(r["k"] for r in spark.table("kept_once").collect()) == [1, 2]
    finally:
        spark.sql("DROP TABLE kept_once")
    for day, text in (("2012-01-01_00001", "m e c 5 why\nbad"), ("2012-01-01_00002", "m e c x why\nn e c 7 because"), ("2012-01-02_00001", "o e c 9 why")):
        (tmp_path / f"click-{day}").write_text(text)
    got = logs.click_log(spark, str(tmp_path / "click-2012-01-01_?????"))
    assert sorted((r["machine"], r["score"]) for r in got.collect()) == [("m", 5), ("n", 7)]
    cookies = spark.createDataFrame([("host TRUE / FALSE 0 name value",), ("short",)], "value string")
    assert logs.cookie_value(cookies, "name").first()["value"] == "value"
    with pytest.raises(ValueError, match="no database"):
        logs.jdbc(spark, [], "SELECT 1")


def test_colours(spark, tmp_path):
    """A bitmap of 2 by 2 pixels, three of them red, and a file that is no image."""
    red, blue = bytes([0, 0, 255]), bytes([255, 0, 0])  # blue, green, red
    pixels = red + red + b"\0\0" + red + blue + b"\0\0"
    head = b"BM" + (54 + len(pixels)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
    info = (40).to_bytes(4, "little") + (2).to_bytes(4, "little") * 2 + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
    (tmp_path / "a.bmp").write_bytes(head + info + pixels)
    (tmp_path / "b.bmp").write_bytes(b"no image")
    got = sorted((r["coords"], r["weight"]) for r in images.colours(spark, str(tmp_path)).collect())
    assert got == [([0.0, 0.0, 255.0], 1.0), ([255.0, 0.0, 0.0], 3.0)]
