"""Queries of the library's own operators over the test tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions import dates, text, udfs, vectors
from clickloom.operators import enrich, features, flow, models, scoring
from clickloom.sources import logs, records, sinks
from clickloom.sources.tables import signals_docs, signals_events, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

EVENTS_CTE = """
base AS (
  SELECT user_id, CAST(ts AS DATE) AS day, least(1.0::DOUBLE, 0.5::DOUBLE * count(*) FILTER (WHERE event_type = 'purchase')) AS result
  FROM events GROUP BY 1, 2
), feat AS (
  SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, unnest([CASE WHEN event_type <> 'purchase' THEN 'type_' || event_type END, 'hour_' || hour(ts), 'weekday_' || (isodow(ts) - 1)]) AS feature FROM events
), longs AS (
  SELECT user_id, day, result, feature FROM base JOIN feat USING (user_id, day)
  WHERE feature IS NOT NULL AND NOT starts_with(feature, 'hour_') AND NOT starts_with(feature, 'weekday_')
)"""
DOCS_CTE = """
sample AS (
  SELECT d.doc_id AS sample_id, CAST(quality AS DOUBLE) AS result, n_chars,
         ['lang_' || lang, 'src_' || source, 'len_' || (CASE WHEN n_chars >= 5000 THEN 3 WHEN n_chars >= 1000 THEN 2 WHEN n_chars >= 200 THEN 1 ELSE 0 END)] AS names
  FROM documents d JOIN labels USING (doc_id)
), longs AS (SELECT sample_id, result, unnest(names) AS feature FROM sample),
cells AS (
  SELECT feature, count(*) FILTER (WHERE result > 0) AS a, count(*) FILTER (WHERE NOT result > 0) AS b FROM longs GROUP BY 1
), cont AS (
  SELECT feature, a, b, (SELECT count(*) FROM sample WHERE result > 0) - a AS c, (SELECT count(*) FROM sample WHERE NOT result > 0) - b AS d FROM cells
)"""
#: A fixed model for the scoring queries.
WEIGHTS = {"(Intercept)": -1.2, "type_click": 0.8, "type_view": 0.4, "type_error": -0.6, "type_signup": 0.3, "type_click&type_view": 0.25}
_LINEAR = """(-1.2 + 0.8 * max(CASE WHEN feature = 'type_click' THEN 1 ELSE 0 END) + 0.4 * max(CASE WHEN feature = 'type_view' THEN 1 ELSE 0 END)
 - 0.6 * max(CASE WHEN feature = 'type_error' THEN 1 ELSE 0 END) + 0.3 * max(CASE WHEN feature = 'type_signup' THEN 1 ELSE 0 END)
 + 0.25 * max(CASE WHEN feature = 'type_click' THEN 1 ELSE 0 END) * max(CASE WHEN feature = 'type_view' THEN 1 ELSE 0 END))::DOUBLE"""
_SCORED = f"WITH {EVENTS_CTE}, lin AS (SELECT user_id, day, {_LINEAR} AS e FROM base LEFT JOIN longs USING (user_id, day) GROUP BY 1, 2)"
_PAIRS = "pairs AS (SELECT d.doc_id AS id, CAST(quality AS DOUBLE) AS actual, least(1.0, n_chars / 20000.0)::DOUBLE AS predicted FROM documents d JOIN labels USING (doc_id))"
_CURVE = f"""{_PAIRS}, tot AS (SELECT sum(actual) AS pos, sum(greatest(0, 1 - actual)) AS neg FROM pairs),
curve AS (SELECT id, predicted, sum(greatest(0, 1 - actual)) OVER w / neg AS x, sum(actual) OVER w / pos AS y FROM pairs, tot WINDOW w AS (ORDER BY predicted DESC, id ROWS UNBOUNDED PRECEDING)),
byx AS (SELECT round(x, 12) AS x, min(y) AS lo, max(y) AS hi FROM (SELECT x, y FROM curve UNION ALL SELECT 0.0, 0.0) GROUP BY 1),
steps AS (SELECT x, lo, hi, lag(x) OVER (ORDER BY x) AS px, lag(lo) OVER (ORDER BY x) AS plo, lag(hi) OVER (ORDER BY x) AS phi FROM byx)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.usable(signals_events(spark, sf_dir))


@query(f"WITH {EVENTS_CTE} SELECT feature, sum(result) AS total, count(*) AS n FROM longs GROUP BY 1")
def signal_stats(spark, sf_dir):
    return features.stats(_samples(spark, sf_dir))


@query(f"WITH {EVENTS_CTE} SELECT feature, count(*) AS n, round(sum(result) / count(*) / (SELECT avg(result) FROM base), 6) AS lift FROM longs GROUP BY 1 ORDER BY 3 DESC, 1 DESC LIMIT 10")
def signal_lift_topk(spark, sf_dir):
    return features.lifts(_samples(spark, sf_dir)).orderBy(F.desc("lift"), F.desc("feature")).limit(10).select("feature", "n", _r("lift"))


@query("""SELECT user_id, n, CAST(b AS BIGINT) AS budget, CAST(floor(b * 2.5) AS BIGINT) AS amplified
FROM (SELECT *, least(n, 1000) // 100 + greatest(0, least(n - 1000, 5000)) // 200 + greatest(0, least(n - 6000, 30000)) // 300 + greatest(0, least(n - 36000, 1000000)) // 400 AS b FROM (SELECT user_id, count(*) * 977 AS n FROM events GROUP BY 1))""")
def feature_budget(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("user_id").agg((F.count("*") * 977).alias("n"))
    return n.withColumn("budget", vectors.budget(F.col("n"))).withColumn("amplified", vectors.budget(F.col("n"), 2.5))


@query(f"""WITH {EVENTS_CTE}, l AS (SELECT feature, count(*) AS n, sum(result) / count(*) / (SELECT avg(result) FROM base) AS lift FROM longs GROUP BY 1),
size AS (SELECT count(*) AS n FROM base),
bud AS (SELECT least(n, 1000) // 100 + greatest(0, least(n - 1000, 5000)) // 200 + greatest(0, least(n - 6000, 30000)) // 300 + greatest(0, least(n - 36000, 1000000)) // 400 AS k FROM size),
r AS (SELECT feature, row_number() OVER (ORDER BY n * abs(1 - lift) DESC, feature DESC) AS place FROM l), sel AS (SELECT feature FROM r, bud WHERE place <= k)
SELECT user_id, day, CAST(count(s.feature) AS INTEGER) AS n_kept FROM base LEFT JOIN longs USING (user_id, day) LEFT JOIN sel s ON longs.feature = s.feature GROUP BY 1, 2""")
def bayes_select(spark, sf_dir):
    s = _samples(spark, sf_dir)
    return features.restrict(s, features.top_features(s)).select("user_id", "day", F.size("features").alias("n_kept"))


@query(f"""WITH {DOCS_CTE} SELECT feature, a, b, c, d, round(CASE WHEN (a + c) * (b + d) * (a + b) * (c + d) > 0
THEN CAST(a + b + c + d AS DOUBLE) * (a * d - b * c) * (a * d - b * c) / (CAST(a + c AS DOUBLE) * (b + d) * (a + b) * (c + d)) ELSE 0 END, 6) AS chi FROM cont""")
def chi_square(spark, sf_dir):
    return features.chi_square(signals_docs(spark, sf_dir)).select("feature", "a", "b", "c", "d", _r("chi"))


@query(f"""WITH {DOCS_CTE}, g AS (SELECT feature, a::DOUBLE AS a, b::DOUBLE AS b, c::DOUBLE AS c, d::DOUBLE AS d, (a + b + c + d)::DOUBLE AS n FROM cont),
h AS (SELECT feature,
 (CASE WHEN a + c > 0 THEN -(a + c) / n * log2((a + c) / n) ELSE 0 END + CASE WHEN b + d > 0 THEN -(b + d) / n * log2((b + d) / n) ELSE 0 END)
 - (a + b) / n * (CASE WHEN a > 0 THEN -a / (a + b) * log2(a / (a + b)) ELSE 0 END + CASE WHEN b > 0 THEN -b / (a + b) * log2(b / (a + b)) ELSE 0 END)
 - (c + d) / n * (CASE WHEN c > 0 THEN -c / (c + d) * log2(c / (c + d)) ELSE 0 END + CASE WHEN d > 0 THEN -d / (c + d) * log2(d / (c + d)) ELSE 0 END) AS gain FROM g)
SELECT feature, round(gain, 6) AS gain FROM h WHERE gain > 1e-6""")
def info_gain(spark, sf_dir):
    return features.info_gain(signals_docs(spark, sf_dir)).select("feature", _r("gain"))


@query(f"""WITH {DOCS_CTE}, s AS (SELECT feature, (a + b)::DOUBLE AS n1, (c + d)::DOUBLE AS n0, a::DOUBLE / (a + b) AS p1, c::DOUBLE / nullif(c + d, 0) AS p0 FROM cont),
z AS (SELECT feature, (ln(p1 / (1 - p1)) - ln(p0 / (1 - p0))) / sqrt(1 / (10 * n1 * p1 * (1 - p1)) + 1 / (10 * n0 * p0 * (1 - p0))) AS z FROM s WHERE p1 > 0 AND p1 < 1 AND p0 > 0 AND p0 < 1)
SELECT feature, round(z, 6) AS z, place FROM (SELECT *, (rank() OVER (ORDER BY round(abs(z), 9) DESC) + (count(*) OVER (PARTITION BY round(abs(z), 9)) - 1) / 2.0)::DOUBLE AS place FROM z WHERE abs(z) >= 0.6744897501960817) WHERE place < 400""")
def univariate_screen(spark, sf_dir):
    return features.univariate_screen(signals_docs(spark, sf_dir)).select("feature", _r("z"), "place")


@query(f"WITH {DOCS_CTE} SELECT CAST(row_number() OVER (ORDER BY feature) - 1 AS INTEGER) AS idx, feature FROM (SELECT DISTINCT feature FROM longs)")
def feature_dictionary(spark, sf_dir):
    return features.dictionary(signals_docs(spark, sf_dir))


@query("""SELECT d.doc_id AS sample_id, CASE WHEN lang = 'de' THEN 1.0 ELSE 0.0 END::DOUBLE AS input_0, CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END::DOUBLE AS input_1,
CASE WHEN n_chars < 200 THEN 1.0 ELSE 0.0 END::DOUBLE AS input_2, CAST(quality AS DOUBLE) AS result FROM documents d JOIN labels USING (doc_id)""")
def dense_matrix(spark, sf_dir):
    cells = models.design(signals_docs(spark, sf_dir), ["lang_de", "lang_en", "len_0"])
    return cells.select("sample_id", *[F.get("x", F.lit(i)).alias(f"input_{i}") for i in range(3)], "result")


@query(f"WITH {DOCS_CTE}, names AS (SELECT CAST(row_number() OVER (ORDER BY feature) - 1 AS INTEGER) AS idx, feature FROM (SELECT DISTINCT feature FROM longs)) SELECT sample_id AS row, idx AS col, 1.0::DOUBLE AS value FROM longs JOIN names USING (feature)")
def sparse_entries(spark, sf_dir):
    s = signals_docs(spark, sf_dir)
    return sinks.sparse_entries(s, "sample_id", features.dictionary(s))


@query(f"WITH {EVENTS_CTE} SELECT user_id, day, label, weight FROM (SELECT user_id, day, 1 AS label, result AS weight FROM base UNION ALL SELECT user_id, day, 0, greatest(0, 1 - result) FROM base) WHERE weight > 1e-9")
def label_split(spark, sf_dir):
    return features.split_labels(signals_events(spark, sf_dir)).select("user_id", "day", "label", "weight")


@query(f"WITH {EVENTS_CTE} SELECT round(CASE WHEN count(*) > 3000 THEN avg(result) ELSE 0.02 END, 6)::DOUBLE AS average FROM base")
def const_model(spark, sf_dir):
    return features.constant_model(signals_events(spark, sf_dir)).select(_r("average"))


@query(f"WITH {EVENTS_CTE} SELECT user_id, day, least(result / 0.8, 1.0)::DOUBLE AS result FROM base")
def capped_result(spark, sf_dir):
    return features.capped(signals_events(spark, sf_dir), 0.8).select("user_id", "day", "result")


@query(_SCORED + " SELECT user_id, day, round(CASE WHEN e < -100 THEN 0 ELSE 1 / (1 + exp(-e)) END, 6)::DOUBLE AS predicted FROM lin")
def glm_score_logit(spark, sf_dir):
    return scoring.score(_samples(spark, sf_dir), WEIGHTS).select("user_id", "day", _r("predicted"))


@query(_SCORED + " SELECT user_id, day, round(exp(e), 6)::DOUBLE AS predicted FROM lin")
def glm_score_poisson(spark, sf_dir):
    return scoring.score(_samples(spark, sf_dir), WEIGHTS, "poisson").select("user_id", "day", _r("predicted"))


@query(f"""WITH {EVENTS_CTE}, w AS (SELECT * FROM (VALUES ('type_click', '0.80'), ('type_view', '0.40'), ('type_error', '-0.60'), ('type_signup', '0.30')) AS t(feature, weight))
SELECT user_id, day, coalesce(string_agg(feature || ':' || weight || '*1.00', ' + ' ORDER BY feature) FILTER (WHERE weight IS NOT NULL), '') AS detail FROM base LEFT JOIN longs USING (user_id, day) LEFT JOIN w USING (feature) GROUP BY 1, 2""")
def score_explain(spark, sf_dir):
    return _samples(spark, sf_dir).select("user_id", "day", scoring.explanation(WEIGHTS, F.col("features")).alias("detail"))


@query(f"WITH {EVENTS_CTE} SELECT user_id, day FROM longs WHERE feature IN ('type_click', 'type_view') GROUP BY 1, 2 HAVING count(*) = 2")
def conjunction(spark, sf_dir):
    e = scoring.linear_term({"type_click&type_view": 1.0}, F.col("features"))
    return _samples(spark, sf_dir).filter(e == 1.0).select("user_id", "day")


@query(f"""WITH {EVENTS_CTE}, w AS (SELECT * FROM (VALUES ('type_click', 0.8), ('type_view', 0.4)) AS t(feature, weight))
SELECT user_id, round(sum(coalesce(weight, 0)), 6)::DOUBLE AS linear FROM base LEFT JOIN longs USING (user_id, day) LEFT JOIN w USING (feature) GROUP BY 1""")
def linear_joined(spark, sf_dir):
    w = spark.createDataFrame([("type_click", 0.8), ("type_view", 0.4)], "feature string, weight double")
    return scoring.linear_term_joined(_samples(spark, sf_dir), w, "user_id").select("user_id", _r("linear"))


def _pairs(spark, sf_dir):
    return signals_docs(spark, sf_dir).select(F.col("sample_id").alias("id"), F.col("result").alias("actual"), F.least(F.lit(1.0), F.col("n_chars") / 20000).alias("predicted"))


@query(f"WITH {_PAIRS} SELECT id, actual, round(predicted, 6)::DOUBLE AS predicted FROM pairs")
def validation_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("id", "actual", _r("predicted"))


@query(f"WITH {_CURVE} SELECT id, round(x, 6)::DOUBLE AS x, round(y, 6)::DOUBLE AS y FROM curve")
def roc_curve(spark, sf_dir):
    return scoring.roc(_pairs(spark, sf_dir)).select("id", _r("x"), _r("y"))


@query(f"WITH {_CURVE} SELECT round(sum((x - px) * (lo + phi) / 2), 6)::DOUBLE AS auc FROM steps")
def auc_standard(spark, sf_dir):
    return scoring.auc(_pairs(spark, sf_dir)).select(_r("auc"))


@query(f"WITH {_CURVE} SELECT round(sum((x - px) * (lo + plo) / 2), 6)::DOUBLE AS auc FROM steps")
def auc_compat(spark, sf_dir):
    return scoring.auc(_pairs(spark, sf_dir), mode="compat").select(_r("auc"))


@query(f"WITH {_PAIRS} SELECT round(sum(abs(actual - predicted)), 4)::DOUBLE AS abs_error, sum(actual) AS positive, sum(CASE WHEN actual < 1 THEN 1 - actual ELSE 0 END)::DOUBLE AS negative FROM pairs")
def abs_error(spark, sf_dir):
    return scoring.absolute_error(_pairs(spark, sf_dir)).select(_r("abs_error", 4), "positive", "negative")


@query("""SELECT user_id AS key, arg_max(event_id % 7, ts) FILTER (WHERE event_type = 'click') AS media_id, count(*) FILTER (WHERE event_type = 'view') AS n_trac, count(*) FILTER (WHERE event_type = 'error') AS n_hop
FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_type = 'click') > 0""")
def click_attribution(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "CLICK").when(F.col("event_type") == "view", "TRAC").when(F.col("event_type") == "error", "HOP")
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), kind.alias("kind"), F.col("ts").alias("ord"), (F.col("event_id") % 7).alias("media_id"))
    return enrich.attribute_clicks(log.filter("kind is not null"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 3 THEN 'HOP' ELSE 'CLICK' END AS branch FROM events")
def media_route(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", enrich.route(F.col("event_id") % 7, 3).alias("branch"))


_IP_CTE = "blk AS (SELECT i * 500 AS ip_start, i * 500 + 299 AS ip_end, lpad(CAST((i % 40 + 10) * 10000 + i % 97 AS VARCHAR), 6, '0') AS code FROM range(1, 60) t(i)), probe AS (SELECT event_id, user_id * 37 AS ip FROM events)"


def _ip_sides(spark, sf_dir):
    i = F.col("id")
    blocks = spark.range(1, 60).select((i * 500).alias("ip_start"), (i * 500 + 299).alias("ip_end"), F.lpad(((i % 40 + 10) * 10000 + i % 97).cast("string"), 6, "0").alias("code"))
    return table(spark, sf_dir, "events").select("event_id", (F.col("user_id") * 37).alias("ip")), blocks


@query(f"WITH {_IP_CTE} SELECT event_id, ip, code FROM probe LEFT JOIN blk ON ip BETWEEN ip_start AND ip_end")
def ip_asof_strict(spark, sf_dir):
    return enrich.ip_lookup(*_ip_sides(spark, sf_dir), slot_bits=10)


@query(f"WITH {_IP_CTE}, p AS (SELECT CASE WHEN event_id % 10 <> 0 THEN ip END AS ip FROM probe) SELECT ip, code FROM (SELECT * FROM p UNION ALL SELECT * FROM p) LEFT JOIN blk ON ip BETWEEN ip_start AND ip_end")
def ip_repeated_probes(spark, sf_dir):
    """Probes without a key of their own, each twice, every tenth null: all of them stay."""
    probes, blocks = _ip_sides(spark, sf_dir)
    rows = probes.select(F.when(F.col("event_id") % 10 != 0, F.col("ip")).alias("ip"))
    return enrich.ip_lookup(rows.unionAll(rows), blocks, slot_bits=10)


@query(f"WITH {_IP_CTE} SELECT event_id, ip, code FROM (SELECT event_id, ip * 10 AS ip FROM probe) LEFT JOIN blk ON ip BETWEEN ip_start + 1 AND ip_end OR ip_start = (SELECT min(ip_start) FROM blk) AND ip = ip_start")
def ip_exclusive_start(spark, sf_dir):
    """A block's first address isn't looked for in the block itself, but in the one before, whose end lies below; the first block has none before."""
    probes, blocks = _ip_sides(spark, sf_dir)
    return enrich.ip_lookup(probes.withColumn("ip", F.col("ip") * 10), blocks, exclusive_start=True, slot_bits=10)


@query(f"""WITH {_IP_CTE}, a AS (SELECT DISTINCT code, 'area ' || code AS name FROM blk UNION SELECT DISTINCT substr(code, 1, 4) || '00', 'province ' || substr(code, 1, 4) FROM blk WHERE substr(code, 5) <> '00')
SELECT event_id, ip, blk.code, x.name AS area, y.name AS province FROM probe LEFT JOIN blk ON ip BETWEEN ip_start AND ip_end LEFT JOIN a x ON x.code = blk.code LEFT JOIN a y ON y.code = substr(blk.code, 1, 4) || '00'""")
def ip_region(spark, sf_dir):
    probes, blocks = _ip_sides(spark, sf_dir)
    own = blocks.select("code", F.concat(F.lit("area "), "code").alias("name"))
    above = blocks.filter("substr(code, 5) <> '00'").select(enrich.province(F.col("code")).alias("code"), F.concat(F.lit("province "), F.substring("code", 1, 4)).alias("name"))
    return enrich.ip_region(probes, blocks, own.union(above).distinct(), slot_bits=10)


@query(f"WITH {_IP_CTE} SELECT event_id, ip, CASE WHEN ip BETWEEN (SELECT min(ip_start) FROM blk) AND (SELECT max(ip_end) FROM blk) THEN code END AS code FROM probe ASOF LEFT JOIN blk ON ip >= ip_start")
def ip_asof_compat(spark, sf_dir):
    return enrich.ip_lookup(*_ip_sides(spark, sf_dir), strict_end=False, slot_bits=10)


_CODES = "SELECT c_custkey, lpad(CAST(c_nationkey * 10000 + c_custkey % 50 AS VARCHAR), 6, '0') AS code FROM customer"


def _codes(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.lpad((F.col("c_nationkey") * 10000 + F.col("c_custkey") % 50).cast("string"), 6, "0").alias("code"))


@query(f"""WITH c AS ({_CODES}), inc AS (SELECT lpad(CAST(i * 10000 + CASE WHEN i % 2 = 0 THEN 0 ELSE 7 END AS VARCHAR), 6, '0') AS code, (i * 100.5)::DOUBLE AS income FROM range(0, 25) t(i))
SELECT c_custkey, c.code, coalesce(a.income, b.income, 0)::DOUBLE AS income FROM c LEFT JOIN inc a ON c.code = a.code LEFT JOIN inc b ON substr(c.code, 1, 4) || '00' = b.code""")
def region_fallback(spark, sf_dir):
    income = spark.range(25).select(F.lpad((F.col("id") * 10000 + F.when(F.col("id") % 2 == 0, 0).otherwise(7)).cast("string"), 6, "0").alias("code"), (F.col("id") * 100.5).alias("income"))
    return enrich.region_income(_codes(spark, sf_dir), income)


@query("SELECT n_name, CASE n_regionkey WHEN 0 THEN 'W' WHEN 1 THEN 'E' WHEN 2 THEN 'M' ELSE 'N/A' END AS zone FROM nation")
def tz_band(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_name", enrich.band(F.col("n_regionkey").cast("string"), {"0": "W", "1": "E", "2": "M"}).alias("zone"))


@query("SELECT n_name, CASE n_nationkey % 8 WHEN 0 THEN 'NW' WHEN 1 THEN 'SW' WHEN 2 THEN 'SE' WHEN 3 THEN 'M' WHEN 4 THEN 'ME' WHEN 5 THEN 'NE' WHEN 6 THEN 'N' ELSE 'N/A' END AS area FROM nation")
def big_area(spark, sf_dir):
    areas = dict(enumerate("NW SW SE M ME NE N".split()))
    return table(spark, sf_dir, "nation").select("n_name", enrich.band((F.col("n_nationkey") % 8).cast("string"), {str(k): v for k, v in areas.items()}).alias("area"))


@query("""SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'only_left' WHEN a.path IS NULL THEN 'only_right' WHEN a.length = b.length THEN 'same' ELSE 'size' END AS state
FROM (SELECT p_partkey AS path, p_size AS length FROM part WHERE p_partkey % 3 <> 0) a FULL JOIN (SELECT p_partkey AS path, CASE WHEN p_partkey % 10 = 0 THEN p_size + 1 ELSE p_size END AS length FROM part WHERE p_partkey % 5 <> 0 OR p_partkey % 10 = 0) b ON a.path = b.path""")
def listing_diff(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    right = p.filter((k % 5 != 0) | (k % 10 == 0)).select(k.alias("path"), F.when(k % 10 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("length"))
    return enrich.listing_diff(p.filter(k % 3 != 0).select(k.alias("path"), F.col("p_size").alias("length")), right)


@query("SELECT p_name AS feature, round(p_retailprice / 1000, 6)::DOUBLE AS weight FROM part WHERE p_size <= 10 ORDER BY p_retailprice, p_name")
def coef_names(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("idx", F.col("p_partkey") - 1)
    coef = p.filter("p_size <= 10").select("idx", (F.col("p_retailprice") / 1000).alias("weight"))
    return coef.join(p.select("idx", F.col("p_name").alias("feature")), "idx").select("feature", _r("weight")).orderBy("weight", "feature")


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def semi_features(spark, sf_dir):
    chosen = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(chosen, "l_suppkey", "left_semi").select("l_orderkey", "l_linenumber", "l_suppkey")


@query("""SELECT coalesce(b.word, a.word) AS word, coalesce(b.freq, a.freq) AS freq FROM (SELECT p_type AS word, count(*) AS freq FROM part WHERE p_size <= 30 GROUP BY 1) a
FULL JOIN (SELECT p_type AS word, sum(p_size)::BIGINT AS freq FROM part WHERE p_size > 45 GROUP BY 1) b ON a.word = b.word""")
def dict_overlay(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("word", F.col("p_type"))
    return enrich.overlay(p.filter("p_size <= 30").groupBy("word").agg(F.count("*").alias("freq")), p.filter("p_size > 45").groupBy("word").agg(F.sum("p_size").alias("freq")))


@query("SELECT page_id, coalesce(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), ''), '') AS page FROM pages")
def url_arg(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.url_arg(F.col("url"), "page").alias("page"))


@query("""WITH q AS (SELECT page_id, CASE WHEN instr(url, '?') > 0 THEN substr(url, instr(url, '?') + 1) ELSE url END || '&page=2;x=a%20+b&none=&page=' || page_id AS query FROM pages),
p AS (SELECT page_id, unnest(string_split_regex(query, '[&;]')) AS pair, unnest(range(0, len(string_split_regex(query, '[&;]')))) AS n FROM q),
v AS (SELECT page_id, n, url_decode(replace(split_part(pair, '=', 1), '+', ' ')) AS k, url_decode(replace(substr(pair, instr(pair, '=') + 1), '+', ' ')) AS v FROM p WHERE regexp_matches(pair, '^[^=]+=.+')),
g AS (SELECT page_id, k, string_agg(v, '|' ORDER BY n) AS vs FROM v GROUP BY 1, 2)
SELECT page_id, string_agg(k || '=' || vs, '&' ORDER BY k) AS args FROM g GROUP BY 1""")
def query_map(spark, sf_dir):
    """All decoded arguments by name, repeated ones in order, blank ones left out."""
    query = F.concat(text.query_part(F.col("url")), F.lit("&page=2;x=a%20+b&none=&page="), "page_id")
    args = F.array_sort(F.map_entries(text.query_map(query)))
    shown = F.array_join(F.transform(args, lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|"))), "&")
    return table(spark, sf_dir, "pages").select("page_id", shown.alias("args"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'a' || event_id ELSE 'b' || event_id END AS key, event_id % 4 IN (2, 3) AS landing FROM events")
def landing_flag(spark, sf_dir):
    i = F.col("event_id")
    q = F.when(i % 4 == 0, F.lit("x=1")).when(i % 4 == 1, F.concat(F.lit("uctrac_eid_1=a"), i, F.lit("&uctrac_eid=z"))).otherwise(F.concat(F.lit("uctrac_eid=b"), i))
    key, landing = text.click_key(q)
    return table(spark, sf_dir, "events").select("event_id", key.alias("key"), landing.alias("landing"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS item FROM events")
def jsonp_item(spark, sf_dir):
    wrapped = F.concat(F.lit("cb("), "props", F.lit(");"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(text.jsonp(wrapped), "$.k").alias("item"))


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) || ',x' AS cust, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS status, CAST(o_custkey AS VARCHAR) AS digits FROM orders")
def kv_scrape(spark, sf_dir):
    line = F.concat(F.lit("bid=3, id="), "o_orderkey", F.lit(", cust="), "o_custkey", F.lit(",x"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("; 'status':'"), "o_orderstatus", F.lit("'"))).otherwise(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", *[text.scrape(line, k).alias(k) for k in ("id", "cust", "status")], text.scrape_number(line, "cust").alias("digits"))


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS inside, o_orderstatus AS quoted, CAST(o_custkey AS VARCHAR) AS plain FROM orders")
def relaxed_json(spark, sf_dir):
    page = F.concat(F.lit("<b>(no)</b> lead cb("), "o_custkey", F.lit(") and (more)"))
    json = F.concat(F.lit('{1:"'), "o_orderstatus", F.lit('", "2": '), "o_custkey", F.lit(", 33 : [1, 2]}"))
    m = text.relaxed_json(json, "map<string,string>")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.jsonp_after(page, "lead").alias("inside"), m["1"].alias("quoted"), m["2"].alias("plain"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a' || event_id WHEN 1 THEN 'b' || event_id WHEN 2 THEN 'c' || event_id END AS key FROM events")
def hop_key(spark, sf_dir):
    i = F.col("event_id")
    referer = F.when(i % 4 == 0, F.concat(F.lit("http://h/p?uctrac_clk=z&uctrac_clk_1=a"), i)).when(i % 4 == 1, F.concat(F.lit("http://h/p?uctrac_clk=b"), i)).when(i % 4 == 2, F.concat(F.lit("uctrac_clk_1=&uctrac_clk=c"), i)).otherwise("http://h/p?q=1")
    return table(spark, sf_dir, "events").select("event_id", text.hop_key(referer).alias("key"))


@query("SELECT o_orderkey, o_orderkey % 6 IN (0, 1, 2, 3) AS every, CASE WHEN o_orderkey % 3 < 2 THEN o_orderstatus END AS first FROM orders")
def predicates(spark, sf_dir):
    k = F.col("o_orderkey")
    flags = F.when(k % 6 == 0, F.array().cast("array<boolean>")).when(k % 6 < 4, F.array(F.lit(True), k >= 0)).when(k % 6 == 4, F.array(F.lit(True), F.lit(None))).otherwise(F.array(F.lit(False)))
    texts = F.when(k % 3 < 2, F.array(F.lit(None), F.lit(""), "o_orderstatus", F.lit("z"))).otherwise(F.array(F.lit("")))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.all_true(flags).alias("every"), text.first_truthy(texts).alias("first"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ma')")
def grep(spark, sf_dir):
    return flow.piped(table(spark, sf_dir, "part").select("p_partkey", "p_name"), lambda rows: flow.grep(rows, "p_name", "ma"))


_GRAMS = """WITH w AS (SELECT unnest(string_split_regex({column}, '\\s+')) AS t FROM {table}), t AS (SELECT t, length(t) AS n, count(*) AS k FROM w WHERE t <> '' GROUP BY 1, 2),
g AS (SELECT t AS gram, k FROM t WHERE n <= 2 UNION ALL SELECT substr(t, i, m), k FROM (SELECT t, n, k, i, unnest(range(2, least({longest}, n - i + 1) + 1)) AS m FROM (SELECT t, n, k, unnest(range(1, n)) AS i FROM t WHERE n > 2)))
SELECT gram, sum(k)::BIGINT AS n FROM g GROUP BY 1"""


@query(_GRAMS.format(column="p_name", table="part", longest=1000))
def ngram_count(spark, sf_dir):
    """All lengths."""
    return table(spark, sf_dir, "part").select(F.explode(text.ngrams(F.col("p_name"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query(_GRAMS.format(column="text", table="documents", longest=3))
def ngram_count_limited(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(text.ngrams(F.col("text"), 3)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query(r"""WITH w AS (SELECT unnest(string_split_regex(lower(translate(text, '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', '                                ')), '\s+')) AS word FROM (SELECT unnest(string_split(CASE WHEN doc_id % 3 = 0 THEN ' .. ' || text ELSE text END, chr(10))) AS text FROM documents) WHERE NOT starts_with(ltrim(text), '..'))
SELECT word, count(*) AS n FROM w WHERE regexp_full_match(word, '[a-z]+') AND word NOT IN ('a', 'an', 'and', 'are', 'as', 'be', 'for', 'if', 'in', 'is', 'it', 'of', 'or', 'py', 'rst', 'the', 'to', 'with') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def word_count_top20(spark, sf_dir):
    """Every third document's first line is made a comment, which doesn't count."""
    marked = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" .. "), "text")).otherwise(F.col("text"))
    return flow.top_words(table(spark, sf_dir, "documents").withColumn("text", marked), "text")


@query("""WITH d AS (SELECT p_brand AS word, count(*) AS freq FROM part GROUP BY 1 HAVING count(*) > 1) SELECT word, round(length(word) * ln(freq) - ln((SELECT sum(freq) FROM d)), 6)::DOUBLE AS logp FROM d""")
def dict_logprob(spark, sf_dir):
    entries = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("word")).agg(F.count("*").alias("freq"))
    return flow.dictionary_logs(entries)[0].select("word", _r("logp"))


@query("""WITH d AS (SELECT p_brand AS word, count(*) AS freq FROM part GROUP BY 1 HAVING count(*) > 1), c AS (SELECT unnest(string_split(word, '')) AS ch, freq FROM d)
SELECT ch, round(ln(sum(freq)) - ln((SELECT sum(freq) FROM d)), 6)::DOUBLE AS logp FROM c GROUP BY 1""")
def char_logprob(spark, sf_dir):
    entries = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("word")).agg(F.count("*").alias("freq"))
    return flow.dictionary_logs(entries)[1].select("ch", _r("logp"))


@query("SELECT doc_id, NOT regexp_full_match(text, '[\\x01-\\x7e]+') AS cjk FROM documents")
def is_cjk(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.is_cjk(F.col("text")).alias("cjk"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey WHEN c_custkey % 3 = 1 THEN -1 ELSE -1 END AS v FROM customer")
def safe_int(spark, sf_dir):
    k = F.col("c_custkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit(" "), k)).when(k % 3 == 1, F.concat(k, F.lit(".5"))).otherwise("n/a")
    return table(spark, sf_dir, "customer").select("c_custkey", text.safe_int(raw).alias("v"))


@query("""WITH h AS (SELECT c_custkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c_name, ''), lambda c: unicode(c)::BIGINT)), lambda a, c: (a * 31 + c) % 4294967296) AS raw FROM customer)
SELECT c_custkey, CASE WHEN raw >= 2147483648 THEN raw - 4294967296 ELSE raw END AS h FROM h""")
def java_hash(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.java_hash(F.col("c_name")).alias("h"))


@query("SELECT event_id, CASE WHEN event_id % 8 < 5 THEN 10 * 16777216 + event_id % 256 WHEN event_id % 8 = 5 THEN event_id ELSE 0 END AS ip FROM events")
def ip_to_int_forms(spark, sf_dir):
    """Four parts, hexadecimal and octal ones, three, two, one; then none of those."""
    i, low = F.col("event_id"), (F.col("event_id") % 256).cast("string")
    forms = [F.concat(F.lit("10.0.0."), low), F.concat(F.lit("0xa.0.0.0x"), F.lower(F.hex(i % 256))), F.concat(F.lit("012.0.00.0"), F.conv(low, 10, 8)), F.concat(F.lit("10.0."), low), F.concat(F.lit("10."), low), i.cast("string")]
    raw = F.when(i % 8 == 6, F.concat(F.lit("10.256.0."), low)).when(i % 8 == 7, F.lit("1.2.3.4.5"))
    for n, form in enumerate(forms):
        raw = F.when(i % 8 == n, form).otherwise(raw)
    return table(spark, sf_dir, "events").select("event_id", text.ip_to_int(raw).alias("ip"))


@query("SELECT event_id, CASE WHEN event_id % 300 > 255 THEN -1 ELSE 10 * 16777216 + (event_id % 300) * 65536 + (event_id % 256) * 256 + 7 END AS ip FROM events")
def ip_to_int(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", text.ip_to_int(F.concat(F.lit("10."), i % 300, F.lit("."), i % 256, F.lit(".7")), -1).alias("ip"))


@query("SELECT o_orderkey, lpad(printf('%x', o_orderkey * 7919), 16, '0') AS key FROM orders")
def hex_key(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.hex_key(F.col("o_orderkey") * 7919).alias("key"))


@query("SELECT l_orderkey, l_linenumber, round(l_tax, 1) AS a, round(l_discount / 3, 1) AS b, round(l_quantity / 7, 1) AS c, l_suppkey AS d FROM lineitem")
def round_nested(spark, sf_dir):
    """A struct that holds a map, an array of arrays and a whole number."""
    nested = F.struct(F.create_map(F.lit("x"), "l_tax").alias("m"), F.array(F.array(F.col("l_discount") / 3), F.array(F.col("l_quantity") / 7)).alias("a"), F.col("l_suppkey").alias("n"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", nested.alias("v"))
    rows = rows.withColumn("v", vectors.rounded(F.col("v"), 1, rows.schema["v"].dataType))
    return rows.select("l_orderkey", "l_linenumber", F.col("v.m")["x"].alias("a"), F.col("v.a")[0][0].alias("b"), F.col("v.a")[1][0].alias("c"), F.col("v.n").alias("d"))


@query("SELECT c_custkey, 'ri-zhong' || replace(c_name, 'C', 'k') || '-' AS v FROM customer")
def pinyin(spark, sf_dir):
    """A table read from lines, first readings only, and fixed punctuation."""
    lines = spark.createDataFrame([("日 ri mi",), ("中 zhong",), ("C k",)], "value string")
    readings = {r["ch"]: r["reading"] for r in logs.readings(lines).collect()}  # a bounded table
    return table(spark, sf_dir, "customer").select("c_custkey", udfs.transliterate(F.concat(F.lit("日，《中》"), "c_name", F.lit("。？")), readings).alias("v"))


@query()
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", udfs.html_text(F.col("html")).alias("text"))


_MIXED = "CASE c_custkey % 3 WHEN 2 THEN 'plain ' || c_custkey ELSE '中文客户' || c_custkey END"


def _mixed(spark, sf_dir):
    """Names in Chinese or English; their bytes in GBK, UTF-8 or ASCII."""
    k = F.col("c_custkey")
    name = F.when(k % 3 == 2, F.concat(F.lit("plain "), k)).otherwise(F.concat(F.lit("中文客户"), k))
    data = F.when(k % 3 == 0, udfs.tolerant_encode(name, "gbk")).otherwise(F.encode(name, "UTF-8"))
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), data.alias("data"))


@query(f"SELECT c_custkey, {_MIXED} AS text, CASE c_custkey % 3 WHEN 0 THEN 'gbk' WHEN 1 THEN 'utf-8' ELSE 'latin' END AS charset FROM customer")
def smart_decode(spark, sf_dir):
    """The charset is chosen by how popular the characters are, as counted in the names themselves."""
    rows = _mixed(spark, sf_dir)
    popular = {r["ch"]: float(r["n"]) for r in flow.popularity(rows, "name").collect()}  # characters, a bounded table
    return rows.select("c_custkey", udfs.smart_decode(F.col("data"), popular).alias("d")).select("c_custkey", "d.text", "d.charset")


@query("SELECT c_custkey, '中' || c_custkey || '文' AS text, round(1.0 / (7 + length(CAST(c_custkey AS VARCHAR))), 6)::DOUBLE AS errors, 'ab' || c_custkey AS kept FROM customer")
def tolerant_decode(spark, sf_dir):
    k = F.col("c_custkey")
    data = F.concat(F.encode(F.concat(F.lit("中"), k), "UTF-8"), F.unhex(F.lit("FF")), F.encode(F.lit("文"), "UTF-8"))
    d = udfs.tolerant_decode(data, "utf-8")
    kept = udfs.tolerant_encode(F.concat(F.lit("a日b"), k), "latin-1").cast("string")
    return table(spark, sf_dir, "customer").select("c_custkey", d.alias("d"), kept.alias("kept")).select("c_custkey", "d.text", F.round("d.errors", 6).alias("errors"), "kept")


@query("SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY 1")
def popularity(spark, sf_dir):
    return flow.popularity(table(spark, sf_dir, "documents"), "text")


@query("SELECT p_partkey, string_split('red green ' || CASE p_partkey % 3 WHEN 0 THEN 'redden' WHEN 1 THEN 'red' ELSE 'x y' END, ' ') AS words FROM part")
def segment(spark, sf_dir):
    """Where several cuts are possible the likelier words win; characters of no word stand alone."""
    words = {"red": -3.0, "green": -3.0, "redden": -4.0, "den": -5.0, "gree": -2.9, "nred": -9.0}
    k = F.col("p_partkey") % 3
    joined = F.concat(F.lit("redgreen"), F.when(k == 0, "redden").when(k == 1, "red").otherwise("xy"))
    return table(spark, sf_dir, "part").select("p_partkey", udfs.segment(joined, words).alias("words"))


@query("SELECT c_custkey, c_name, CASE c_custkey % 2 WHEN 0 THEN 'BBF316E8D940AF0AD3' ELSE '1021BF0420' END AS fixed FROM customer")
def rc4_roundtrip(spark, sf_dir):
    """There and back again, and two published vectors."""
    key = b"a key for tests"
    fixed = F.when(F.col("c_custkey") % 2 == 0, udfs.rc4_column(F.encode(F.lit("Plaintext"), "UTF-8"), b"Key")).otherwise(udfs.rc4_column(F.encode(F.lit("pedia"), "UTF-8"), b"Wiki"))
    return table(spark, sf_dir, "customer").select("c_custkey", udfs.rc4_column(udfs.rc4_column(F.encode("c_name", "UTF-8"), key), key).cast("string").alias("c_name"), F.hex(fixed).alias("fixed"))


_KEY = b"a key for tests"


def _clicks(spark, sf_dir):
    """Encoded click messages of customers: (c_custkey, clkex, clkobj, pv, trac)."""
    k, name = F.col("c_custkey"), F.col("c_name")
    user = F.struct(F.encode(F.lit("x"), "UTF-8").alias("xxid"), F.lit("m").alias("muid"), F.concat(F.lit("http://r/?q="), k).alias("referer"), F.lit(None).cast("string").alias("user_agent"), F.lit(None).cast("string").alias("original_referer"))
    ex = F.struct(user.alias("user_info"), (k + 1000).alias("click_time"), k.alias("click_ip"), name.alias("click_url"), (-k).alias("click_hash"))
    shown = F.struct((k % 7).alias("media_id"), k.alias("display_ip"), (k * 3).alias("display_time"), F.lit(None).cast("long").alias("event_id"), (k % 2 == 0).alias("is_fallback"), F.lit(None).cast("long").alias("channel_id"))
    obj = F.struct(shown.alias("display_info"), F.lit(1).cast("long").alias("frontend_spent"), k.alias("crc32"), F.array(k, k + 1).alias("user_attr_list"), F.lit(False).alias("is_debug"), name.alias("uctrac_clk"))
    pv = F.struct(shown.alias("display_info"), user.alias("user_info"), (k * 2).alias("render_time"))
    trac = F.struct(*[(F.concat(F.lit(f"{n}"), k) if kind == "string" else k % 2 == 1 if kind == "bool" else k + 5).alias(n) for n, (_, kind) in records.TRACKING.items()])
    texts = (records.packed(ex, records.CLICK_EX).alias("clkex"), records.packed(obj, records.CLICK, _KEY).alias("clkobj"), records.packed(pv, records.PAGE_VIEW).alias("pv"), records.tracking_text(trac).alias("trac"))
    # a file of one row group is read by one task; the rows are dealt out before the messages are made
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name").hint("rebalance")
    return rows.select("c_custkey", *texts)


@query("SELECT c_custkey, -c_custkey AS click_hash, 'http://r/?q=' || c_custkey AS referer, c_custkey % 7 AS media_id, [c_custkey, c_custkey + 1] AS attrs, c_name AS clk, c_custkey * 2 AS render_time, c_custkey % 2 = 0 AS is_fallback, TRUE AS broken FROM customer")
def click_messages(spark, sf_dir):
    """Page views, and both parts of clicks, one of them enciphered; a text that is cut short gives null."""
    m = _clicks(spark, sf_dir).select("c_custkey", records.click_ex(F.col("clkex")).alias("x"), records.click(F.col("clkobj"), _KEY).alias("o"), records.page_view(F.col("pv")).alias("p"), records.click_ex(F.substring("clkex", 1, 9)).alias("bad"))
    return m.select("c_custkey", "x.click_hash", "x.user_info.referer", "o.display_info.media_id", F.col("o.user_attr_list").alias("attrs"), F.col("o.uctrac_clk").alias("clk"), "p.render_time", "p.display_info.is_fallback", F.col("bad").isNull().alias("broken"))


@query("SELECT c_custkey, 'click_id' || c_custkey AS click_id, c_custkey + 5 AS utrac_eid, c_custkey % 2 = 1 AS is_landing, c_custkey + 5 AS ip, 'page_path' || c_custkey AS page_path, 'click_hash' || c_custkey AS click_hash FROM customer")
def tracking_roundtrip(spark, sf_dir):
    return _clicks(spark, sf_dir).select("c_custkey", records.tracking_record(F.col("trac")).alias("t")).select("c_custkey", *[f"t.{c}" for c in ("click_id", "utrac_eid", "is_landing", "ip", "page_path", "click_hash")])


@query("SELECT c_custkey, 3 AS n_steps, c_custkey + 1000 AS click_time, c_custkey % 7 AS media_id, TRUE AS others_null FROM customer")
def session_paths(spark, sf_dir):
    """Sessions as arrays of steps; only clicks carry messages."""
    none = F.lit(None).cast("string")
    step = lambda cate, a, b: F.struct(F.lit(cate).alias("cate"), a.alias("clkex"), b.alias("clkobj"))
    rows = _clicks(spark, sf_dir).select("c_custkey", F.array(step("pv", none, none), step("click", F.col("clkex"), F.col("clkobj")), step("pv", F.col("clkex"), none)).alias("paths"))
    p = rows.select("c_custkey", records.session_paths(F.col("paths"), _KEY).alias("p"))
    others = F.col("p")[0]["clkex"].isNull() & F.col("p")[2]["clkex"].isNull()
    return p.select("c_custkey", F.size("p").alias("n_steps"), F.col("p")[1]["clkex"]["click_time"].alias("click_time"), F.col("p")[1]["clkobj"]["display_info"]["media_id"].alias("media_id"), others.alias("others_null"))


# text logs, written out as lines and read again


@query("SELECT event_id, 'm' || user_id AS machine, CAST(event_id % 100 AS INTEGER) AS score FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0")
def click_log_lines(spark, sf_dir):
    """Lines with too few fields or no number for a score are left out."""
    i = F.col("event_id")
    line = F.when(i % 5 == 0, F.concat(F.lit("short "), i)).otherwise(F.concat(F.lit("m"), "user_id", F.lit(" e"), i, F.lit(" c "), F.when(i % 7 == 0, F.lit("x")).otherwise((i % 100).cast("string")), F.lit(" why more")))
    rows = logs.click_lines(table(spark, sf_dir, "events").select(line.alias("value")))
    return rows.select(F.substring("click_ex", 2, 20).cast("long").alias("event_id"), "machine", "score")


@query("SELECT event_id, '10.0.0.' || event_id % 256 AS ip, ts - INTERVAL (microsecond(ts)) MICROSECOND + INTERVAL (second(ts)) SECOND AS ts, 'h' || event_id AS uh, 'é ' || user_id AS up, 'M' || user_id AS muid FROM events WHERE event_id % 9 <> 0")
def tracking_lines(spark, sf_dir):
    i = F.col("event_id")
    stamp = F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss")
    request = F.concat(F.lit("GET /t?uh=x&uv=1&uh=h"), i, F.lit("&up=%C3%A9%20"), "user_id", F.lit(" HTTP/1.1"))
    line = F.concat(F.lit("10.0.0."), i % 256, F.lit(" - - ["), stamp, F.lit(' +0800] "'), request, F.lit('" 200 1 "http://ref/" "agent" "-" "'), F.lit("a=1; MUID=M"), "user_id", F.lit('; YYID=y"'))
    rows = logs.tracking_log(table(spark, sf_dir, "events").select(F.when(i % 9 != 0, line).otherwise("cut short").alias("value")))
    return rows.select(F.substring("uh", 2, 20).cast("long").alias("event_id"), "ip", "ts", "uh", "up", "muid")


@query("SELECT event_type AS series, event_id AS ts, CASE WHEN event_id % 5 <> 0 THEN round(value, 3) END AS value FROM events")
def time_series_json(spark, sf_dir):
    """Of JSON documents, one for each event."""
    shown = F.when(F.col("event_id") % 5 != 0, F.round("value", 3).cast("string")).otherwise("null")
    doc = F.concat(F.lit('[{"target": "'), "event_type", F.lit('", "datapoints": [['), shown, F.lit(", "), "event_id", F.lit("]]}]"))
    return logs.time_series(table(spark, sf_dir, "events").select(doc.alias("value")))


@query("SELECT '/d/' || p_partkey AS path, p_partkey % 2 = 0 AS is_file, p_size::BIGINT AS length FROM part")
def listing_lines(spark, sf_dir):
    k = F.col("p_partkey")
    line = F.concat(F.lit("-rw-r--r--   "), F.when(k % 2 == 0, "3").otherwise("-"), F.lit(" user  group "), "p_size", F.lit(" 2012-01-01 00:00 /d/"), k)
    return logs.listing(table(spark, sf_dir, "part").select(line.alias("value")))


@query("SELECT lpad(CAST(n_nationkey AS VARCHAR), 6, '0') AS code, n_regionkey * 1.5::DOUBLE AS income FROM nation")
def income_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("x\t"), F.lpad(F.col("n_nationkey").cast("string"), 6, "0"), F.lit("\ta\t"), F.col("n_regionkey") * 1.5, F.lit("\tz")).alias("value"))
    return logs.income_dimension(rows.union(spark.createDataFrame([("HEADER\tcode\ta\tincome\tz",)], "value string")))


@query("SELECT n_name AS feature, round(n_regionkey * 0.25, 2)::DOUBLE AS weight FROM nation UNION ALL SELECT '(Intercept)', -1.5")
def model_lines(spark, sf_dir):
    """A coefficient table and its dictionary, joined on the column's number."""
    n = table(spark, sf_dir, "nation")
    coef = n.select(F.concat(F.lit('"input_'), "n_nationkey", F.lit('" '), F.col("n_regionkey") * 0.25).alias("value")).union(spark.createDataFrame([('"x"',), ('"(Intercept)" -1.5',), ('"input_99" NA',)], "value string"))
    return logs.model(coef, n.select(F.concat(F.col("n_nationkey") + 1, F.lit(" "), "n_name").alias("value")))


@query("SELECT label, CAST(n_nationkey AS INTEGER) AS idx, CASE label WHEN 3 THEN n_regionkey * 0.5 ELSE n_nationkey * -0.25 END::DOUBLE AS weight FROM nation, (VALUES (3), (1)) t(label)")
def linear_model_lines(spark, sf_dir):
    """A model of several labels, as one text."""
    row = F.concat((F.col("n_regionkey") * 0.5).cast("string"), F.lit(" "), (F.col("n_nationkey") * -0.25).cast("string"), F.lit(" "))
    body = table(spark, sf_dir, "nation").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("w")))).alias("rows"))
    text_of = F.concat(F.lit("solver_type X\nnr_class 2\nlabel 3 1\nnr_feature 25\nbias -1\nw\n"), F.array_join(F.col("rows.w"), "\n"), F.lit("\n"))
    return logs.linear_model(body.select(text_of.alias("value")))


@query(f"""WITH {DOCS_CTE}, names AS (SELECT row_number() OVER (ORDER BY feature) AS idx, feature FROM (SELECT DISTINCT feature FROM longs)),
filled AS (SELECT sample_id, string_agg(idx || ':1.0', ' ' ORDER BY idx) AS line FROM longs JOIN names USING (feature) GROUP BY 1)
SELECT '1' AS line, 1e-7::DOUBLE AS weight UNION ALL SELECT CASE WHEN result > 0 THEN '1 ' ELSE '0 ' END || line, 1e8::DOUBLE FROM sample JOIN filled USING (sample_id)""")
def weighted_libsvm(spark, sf_dir):
    samples = signals_docs(spark, sf_dir)
    return features.weighted_lines(samples, "sample_id", features.dictionary(samples))


# small relational pieces


@query(f"WITH {DOCS_CTE}, names AS (SELECT CAST(row_number() OVER (ORDER BY feature) - 1 AS INTEGER) AS idx, feature FROM (SELECT DISTINCT feature FROM longs)) SELECT idx AS row, sample_id AS col, 1.0::DOUBLE AS value FROM longs JOIN names USING (feature)")
def transposed(spark, sf_dir):
    s = signals_docs(spark, sf_dir)
    return sinks.transposed(sinks.sparse_entries(s, "sample_id", features.dictionary(s)))


@query("SELECT CAST(n_nationkey AS INTEGER) AS idx, n_name AS feature, (SELECT max(b) FROM range(0, 6) t(b) WHERE floor(25 * b / 6.0) <= n_nationkey)::INTEGER AS block FROM nation")
def column_blocks(spark, sf_dir):
    k = F.col("n_nationkey").cast("int")
    names = table(spark, sf_dir, "nation").select(k.alias("idx"), F.col("n_name").alias("feature"))
    return flow.column_blocks(names, 6)


@query("SELECT p_partkey AS id, p_size + p_retailprice AS total FROM part")
def joined_by_key(spark, sf_dir):
    """Two files of one matrix, put side by side by the sample's key and not by place."""
    x, y = sinks.split_target(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"))
    y = table(spark, sf_dir, "part").select("p_partkey", *y.columns)
    return x.select("p_partkey", "p_size").join(y, "p_partkey").select(F.col("p_partkey").alias("id"), (F.col("p_size") + F.col("p_retailprice")).alias("total"))


@query("SELECT p_type AS word FROM part UNION ALL SELECT p_brand FROM part")
def rows_bound(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_type").alias("word")).unionByName(p.select(F.col("p_brand").alias("word")))


@query("SELECT n_name AS name FROM nation UNION SELECT s_name FROM supplier")
def names_united(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).union(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))).distinct()


@query("SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS place FROM supplier")
def sorted_numbers(spark, sf_dir):
    """Numbered in the order of two columns made one."""
    key = F.col("s_acctbal") * 1e6 + F.col("s_suppkey") / 1e4
    return flow.numbered(table(spark, sf_dir, "supplier").select("s_suppkey", key.alias("k")), "k", "place").drop("k")


@query("SELECT user_id, arg_min(event_id, event_id) AS event_id FROM events GROUP BY 1")
def first_events(spark, sf_dir):
    return flow.first_value(table(spark, sf_dir, "events"), "user_id", "event_id", "event_id")


@query("SELECT p_brand, median(p_size)::DOUBLE AS middle FROM part GROUP BY 1")
def reduced_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", "p_size")
    return flow.group_reduce(rows, "p_brand", lambda g: pd.DataFrame({"p_brand": g["p_brand"].iloc[:1], "middle": [float(g["p_size"].median())]}), "p_brand string, middle double")


@query("SELECT p_type AS word, count(*) AS n FROM part GROUP BY 1")
def mapped_and_reduced(spark, sf_dir):
    def ones(batches):
        for rows in batches:
            yield pd.DataFrame({"word": rows["p_type"], "n": 1})

    def summed(rows):
        return pd.DataFrame({"word": rows["word"].iloc[:1], "n": [int(rows["n"].sum())]})

    return flow.map_reduce(table(spark, sf_dir, "part").select("p_type"), ones, "word string, n long", "word", summed, "word string, n long")


@query("SELECT p_partkey, b.word FROM part JOIN (SELECT DISTINCT p_brand AS word FROM part) b ON substr(p_brand, 1, 2) = substr(b.word, 1, 2) AND starts_with(p_brand || ' x', b.word)")
def prefix_joined(spark, sf_dir):
    """Dictionary words that a text begins with, by a join on their first two characters."""
    p = table(spark, sf_dir, "part")
    words = flow.prefix_index(p.groupBy(F.col("p_brand").alias("word")).agg(F.count("*").alias("freq")))
    rows = p.select("p_partkey", F.concat("p_brand", F.lit(" x")).alias("text"), F.substring("p_brand", 1, 2).alias("prefix"))
    return rows.join(words, "prefix").filter(F.col("text").startswith(F.col("word"))).select("p_partkey", "word")


@query("SELECT lower(column_name) AS name, ordinal_position - 1 AS place FROM information_schema.columns WHERE table_name = 'supplier'")
def column_names(spark, sf_dir):
    return sinks.columns(table(spark, sf_dir, "supplier")).select("name", F.col("place").cast("long").alias("place"))


@query(_SCORED + " SELECT user_id, day, round(CASE WHEN e < -100 THEN 0 ELSE exp(e) END, 6)::DOUBLE AS predicted FROM lin")
def glm_score_log(spark, sf_dir):
    return scoring.score(_samples(spark, sf_dir), WEIGHTS, "log").select("user_id", "day", _r("predicted"))


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, ts, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), r AS (
  SELECT event_id, user_id, ts, rn, t AS now, 0.0::DOUBLE AS level FROM e WHERE rn = 1
  UNION ALL
  SELECT event_id, user_id, ts, rn, CASE WHEN filled < 1 THEN came + (1 - filled) * 86400 / 2 ELSE came END, CASE WHEN filled < 1 THEN 0.0 ELSE filled - 1 END
  FROM (SELECT *, least(2.0::DOUBLE, level + (came - now) * 2 / 86400) AS filled FROM (SELECT e.*, greatest(e.t, r.now) AS came, r.now, r.level FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
) SELECT event_id, user_id, ts, make_timestamp(CAST(floor(now * 1e6 + 0.5) AS BIGINT)) AS admitted FROM r""")
def waiting_bucket(spark, sf_dir):
    return flow.waiting_bucket(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 2, 86400)


@query("SELECT c_custkey, CAST(c_custkey % 128 AS BIGINT) AS id, c_name AS name FROM customer")
def proto_roundtrip(spark, sf_dir):
    name = F.encode("c_name", "UTF-8")
    one = lambda n: F.unhex(F.lpad(F.hex(n), 2, "0"))
    wire = F.concat(one(F.lit(8)), one(F.col("c_custkey") % 128), one(F.lit(18)), one(F.length(name)), name)
    m = udfs.message_column(udfs.url_base64(F.translate(F.base64(wire), "+/\r\n", "-_")), {"id": (1, "long"), "name": (2, "string")})
    return table(spark, sf_dir, "customer").select("c_custkey", m.alias("m")).select("c_custkey", "m.id", "m.name")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) + 10 AS later, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-01') AS INTEGER) AS days, epoch(o_orderdate)::BIGINT AS epoch FROM orders")
def date_plus(spark, sf_dir):
    d = F.to_date("o_orderdate")
    epoch = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_add(d, 10).alias("later"), F.datediff(F.lit("1998-12-01").cast("date"), d).alias("days"), epoch.alias("epoch"))


@query("SELECT o_orderkey, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS dow FROM orders")
def weekday_num(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.weekday("o_orderdate").alias("dow"))


@query("SELECT o_orderkey, CAST(unnest(range(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + INTERVAL (o_orderkey % 4) DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM orders")
def date_span(spark, sf_dir):
    d = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(dates.each_day(d, F.date_add(d, (F.col("o_orderkey") % 4).cast("int")))).alias("day"))


@query("""SELECT o_orderkey, d + ((7 - isodow(d) + 1 - 1) % 7 + 1)::INTEGER AS next_monday, d - ((isodow(d) - 1 + 6) % 7 + 1)::INTEGER AS last_monday FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def next_last_weekday(spark, sf_dir):
    d = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.next_weekday(d, "monday").alias("next_monday"), dates.last_weekday(d, "monday").alias("last_monday"))


#: Free-text dates of every shape, and what they are on Wednesday, 3 June 2020.
_DATES = {
    "-1 week 2 days": "2020-05-25", "-2 weeks": "2020-05-20", "3 days ago": "2020-05-31", "2 weeks 1 day ago": "2020-05-19", "today": "2020-06-03", "now": "2020-06-03", "tomorrow": "2020-06-04", "yesterday": "2020-06-02", "4th": "2020-06-04", "21": "2020-06-21",
    "4th Jan": "2020-01-04", "4th January 2003": "2003-01-04", "Jan 4th": "2020-01-04", "Jan 4th, 2003": "2003-01-04", "3/4/2019": "2019-03-04", "25/12/2019": "2019-12-25", "2019-02-03": "2019-02-03", "20190203": "2019-02-03", "20190203112233": "2019-02-03",
    "next monday": "2020-06-08", "last wednesday": "2020-05-27", "friday": "2020-05-29", "no date": None, "30th Feb": None,
}
_TIMES = {"-1 day 2 hours": "2020-06-02 08:20:30", "3 hours 20 minutes 30 seconds ago": "2020-06-03 07:00:00", "now": "2020-06-03 10:20:30", "20190203112233": "2019-02-03 11:22:33", "tomorrow": "2020-06-04 00:00:00", "no date": None}


def _picked(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


@query(f"SELECT o_orderkey, CAST(({_picked(_DATES.values())})[o_orderkey % {len(_DATES)} + 1] AS DATE) AS day FROM orders")
def magic_date(spark, sf_dir):
    raw = F.get(F.array(*map(F.lit, _DATES)), (F.col("o_orderkey") % len(_DATES)).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.magic_date(raw, F.lit("2020-06-03").cast("date")).alias("day"))


@query(f"SELECT o_orderkey, CAST(({_picked(_TIMES.values())})[o_orderkey % {len(_TIMES)} + 1] AS TIMESTAMP) AS at FROM orders")
def magic_time(spark, sf_dir):
    raw = F.get(F.array(*map(F.lit, _TIMES)), (F.col("o_orderkey") % len(_TIMES)).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.magic_time(raw, F.lit("2020-06-03 10:20:30").cast("timestamp_ntz")).alias("at"))


@query("SELECT event_id, event_id % 3 * 86400 + event_id % 24 * 3600 + event_id % 60 * 60 + event_id % 59 AS seconds FROM events")
def elapsed_seconds(spark, sf_dir):
    i = F.col("event_id")
    raw = F.concat(i % 3, F.lit("-"), F.lpad((i % 24).cast("string"), 2, "0"), F.lit(":"), F.lpad((i % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((i % 59).cast("string"), 2, "0"))
    return table(spark, sf_dir, "events").select("event_id", text.elapsed_seconds(raw).alias("seconds"))


@query("SELECT p_partkey, CAST((p_size >= 5)::INT + (p_size >= 20)::INT + (p_size >= 40)::INT AS INTEGER) AS bucket FROM part")
def bucketize(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", vectors.bucketise(F.col("p_size"), [5, 20, 40]).alias("bucket"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: (x::DOUBLE - 0.1) * (x::DOUBLE - 0.1)))), 4)::DOUBLE AS dist FROM embeddings")
def euclid(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.euclid(v, F.transform(v, lambda x: F.lit(0.1))), 4).alias("dist"))


@query("SELECT p_brand, round(sum(p_size * p_retailprice) / sum(p_retailprice), 4)::DOUBLE AS centre FROM part GROUP BY 1")
def weighted_centroid(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(F.sum(F.col("p_size") * F.col("p_retailprice")) / F.sum("p_retailprice"), 4).alias("centre"))


@query("""WITH p AS (SELECT p_size::DOUBLE AS x, p_retailprice / 100 AS y FROM part), a AS (SELECT x, y, CASE WHEN (x - 10) * (x - 10) + (y - 10) * (y - 10) <= (x - 40) * (x - 40) + (y - 15) * (y - 15) THEN 0 ELSE 1 END AS cluster FROM p)
SELECT cluster, count(*) AS n, round(avg(x), 4)::DOUBLE AS cx, round(avg(y), 4)::DOUBLE AS cy FROM a GROUP BY 1""")
def kmeans_step(spark, sf_dir):
    points = table(spark, sf_dir, "part").select(F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 100).alias("coords"), F.lit(1.0).alias("weight"))
    c = models.kmeans_step(points, [[10.0, 10.0], [40.0, 15.0]])
    return c.select("cluster", "n", F.round(c["center"][0], 4).alias("cx"), F.round(c["center"][1], 4).alias("cy"))


@query("SELECT event_id, user_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 5 AS BIGINT) AS chunk FROM events")
def chunk_rows(spark, sf_dir):
    return flow.chunks(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 5).select("event_id", "user_id", "chunk")


_SERIES = "s AS (SELECT event_type AS series, event_id AS ts, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value FROM events)"


def _series(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.col("event_id").alias("ts"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"))


_LAST = f"{_SERIES}, ok AS (SELECT *, max(CASE WHEN coalesce(value <> 0, false) THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY ts DESC ROWS UNBOUNDED PRECEDING) AS good FROM s), p AS (SELECT series, ts, value, CAST(row_number() OVER (PARTITION BY series ORDER BY ts DESC) AS INTEGER) AS place FROM ok WHERE good = 1)"


@query(f"WITH {_LAST} SELECT series, ts, value, place FROM p WHERE place <= 4")
def take_last_n(spark, sf_dir):
    return flow.last_points(_series(spark, sf_dir), 4)


@query(f"WITH {_LAST} SELECT series, bool_and(coalesce(value > 1, false)) AS alert FROM p WHERE place <= 2 GROUP BY 1")
def threshold_alert(spark, sf_dir):
    return flow.alerts(_series(spark, sf_dir), 2, 1.0)


_IN_TURN = "e AS (SELECT event_id, user_id, ts, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"


@query(f"""WITH RECURSIVE {_IN_TURN}, r AS (
  SELECT event_id, user_id, ts, t, rn, 1.0::DOUBLE AS level, TRUE AS ok FROM e WHERE rn = 1
  UNION ALL
  SELECT event_id, user_id, ts, t, rn, CASE WHEN filled >= 1 THEN filled - 1 ELSE filled END, filled >= 1
  FROM (SELECT e.*, least(2.0::DOUBLE, r.level + (e.t - r.t) * 2 / 86400) AS filled FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
) SELECT event_id, user_id, ts FROM r WHERE ok""")
def token_bucket(spark, sf_dir):
    return flow.token_bucket(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 2, 86400)


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
def sql_passthrough(spark, sf_dir):
    return spark.sql("SELECT o_orderstatus, count(*) AS n FROM {o} WHERE o_totalprice > :least GROUP BY 1", args={"least": 1000}, o=table(spark, sf_dir, "orders"))


@query("SELECT 'INSERT INTO nations (n_nationkey, n_name) VALUES (' || n_nationkey || ', ''' || replace(n_name, '''', '''''') || ''');' AS sql FROM nation")
def insert_statements(spark, sf_dir):
    return sinks.insert_sql(table(spark, sf_dir, "nation"), "nations", ["n_nationkey", "n_name", "unknown"])


@query("SELECT 'orders.' || o_orderstatus || ':' || count(*) || '|c|@0.5' AS line FROM orders GROUP BY o_orderstatus")
def metric_lines(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return n.select(sinks.metric_line(F.concat(F.lit("orders."), "o_orderstatus"), F.col("n"), "c", 0.5).alias("line"))


@query("SELECT o_orderkey, CAST(ntile(7) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS block FROM orders")
def row_blocks(spark, sf_dir):
    return flow.row_blocks(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 7)


@query("SELECT c_custkey, 'China' AS country, CASE c_nationkey % 2 WHEN 0 THEN 'Hubei' ELSE 'Hunan' END AS province, CASE c_nationkey % 2 WHEN 0 THEN 'Wuhan' END AS city FROM customer")
def place_scan(spark, sf_dir):
    places = pd.DataFrame([("China", "Hubei", "Wuhan"), ("China", "Hunan", "Changsha"), ("Japan", "", "")], columns=["country", "province", "city"])
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 2 == 0, "1 Road, Wuhan").otherwise("2 Road, Hunan").alias("address"))
    return enrich.place_scan(rows, places).drop("address")


def _fitted(name: str) -> None:
    def run(spark, sf_dir):
        s = signals_docs(spark, sf_dir)
        return models.as_frame(s, models.train(name, s))

    run.__name__ = f"fit_{name}"
    _QUERIES[run.__name__] = run


for _name in models.MODELS:
    _fitted(_name)
_SQL["fit_const"] = f"WITH {DOCS_CTE} SELECT 'Average' AS feature, (CASE WHEN count(*) > 3000 THEN avg(result) ELSE 0.02 END)::DOUBLE AS weight FROM sample"


@query()
def fit_kmeans(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("coords"), F.lit(1.0).alias("weight"))
    return models.kmeans(e, 4)
