"""Queries on model costs, budgets, rate limits and caps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accounting as op
from ..sources import adapters as a
from .base import Entry

PRICES = [("user", 2.5, 15.0), ("assistant", 1.0, 6.0)]
PRICE_SQL = ", pricing(model, price_in, price_out) AS (VALUES ('user', 2.5::DOUBLE, 15.0::DOUBLE), ('assistant', 1.0::DOUBLE, 6.0::DOUBLE))"


def _prices(spark):
    return spark.createDataFrame(PRICES, "model string, price_in double, price_out double")


def cost_estimate(spark, sf_dir):
    d = a.read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("pages"), F.sum("n_chars").alias("chars"), F.count_if(F.expr("doc_id % 9 = 0")).alias("equations"))
    runs = d.selectExpr("source as run", "case length(source) when 4 then 'user' else 'other' end as model", "case when source like '%2' then 'nobody' else 'assistant' end as vision_model", "pages", "chars", "equations")
    return op.estimate(runs, _prices(spark))


ESTIMATE = """WITH pricing(model, price_in, price_out) AS (VALUES ('user', 2.5::DOUBLE, 15.0::DOUBLE), ('assistant', 1.0::DOUBLE, 6.0::DOUBLE)),
r AS (SELECT source AS run, CASE length(source) WHEN 4 THEN 'user' ELSE 'other' END AS model, CASE WHEN source LIKE '%2' THEN 'nobody' ELSE 'assistant' END AS vision, count(*) AS pages, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) FILTER (WHERE doc_id % 9 = 0) AS equations FROM documents GROUP BY 1, 2, 3),
s AS (SELECT *, (pages + 7) // 8 AS seg, CASE WHEN chars > 0 THEN 2 ELSE 0 END AS bib, equations * 1300 AS vin, equations * 1024 AS vout FROM r),
t AS (SELECT *, CASE WHEN seg > 0 THEN (chars + 3) // 4 + 500 * seg ELSE 0 END AS seg_in FROM s),
u AS (SELECT *, seg_in + vin + 500 * bib AS tin, CASE WHEN seg > 0 THEN seg * least(seg_in // seg, 4096) ELSE 0 END + vout + bib * least(greatest(500, chars // 20), 4096) AS tout FROM t)
SELECT run, u.model, seg + equations + bib AS calls, tin AS tokens_in, tout AS tokens_out,
  round(((tin - vin) * p.price_in + (tout - vout) * p.price_out + CASE WHEN equations > 0 THEN vin * v.price_in + vout * v.price_out ELSE 0 END) / 1e6, 6) AS usd
FROM u LEFT JOIN pricing p ON u.model = p.model LEFT JOIN pricing v ON u.vision = v.model"""

COSTED = """, c AS (SELECT k.*, price_in, price_out, CASE WHEN cache_hit THEN 0 ELSE prompt_tokens END AS bill_in, CASE WHEN cache_hit THEN 0 ELSE completion_tokens END AS bill_out
FROM calls k LEFT JOIN pricing p ON k.model = p.model),
h AS (SELECT *, (bill_in * coalesce(price_in, 10) + bill_out * coalesce(price_out, 30)) / 1e6 AS held, (bill_in * price_in + bill_out * price_out) / 1e6 AS usd FROM c)"""


def _costed(spark, sf_dir):
    return op.cost(a.calls(spark, sf_dir), _prices(spark))


def ledger_rollup(spark, sf_dir):
    return op.rollup(_costed(spark, sf_dir))


def ledger_stop(spark, sf_dir):
    return op.first_rejected(_costed(spark, sf_dir), 0.003, 300)


STOP = """, s AS (SELECT run, seq, sum(held) OVER w AS spent, cache_hit, sum(bill_in + bill_out) OVER w AS tokens, bool_or(price_in IS NULL AND NOT cache_hit) OVER w AS unknown FROM h
WINDOW w AS (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT run, min(seq) AS seq FROM s WHERE NOT cache_hit AND (round(spent, 9) > 0.003 OR unknown AND tokens > 300) GROUP BY run"""


def request_key(spark, sf_dir):
    d = a.read(spark, sf_dir, "conversations")
    return d.selectExpr("conv_id", "turn", "sha2(concat_ws('|', role, text, 'v1'), 256) as key")


def cache_hit_split(spark, sf_dir):
    """Calls by whether a shorter table of stored answers has their key; stored keys are made distinct first."""
    d = a.read(spark, sf_dir, "conversations")
    stored = d.where("conv_id % 2 = 0").selectExpr("sha2(concat_ws('|', role, text), 256) as key").distinct().withColumn("hit", F.lit(True))
    asked = d.selectExpr("role", "sha2(concat_ws('|', role, text), 256) as key")
    j = asked.join(stored, "key", "left")
    return j.groupBy("role").agg(F.count("hit").alias("hits"), F.count_if(F.expr("hit is null")).alias("misses"))


SPLIT = """WITH s AS (SELECT DISTINCT sha256(role || '|' || text) AS key FROM conversations WHERE conv_id % 2 = 0)
SELECT role, count(s.key) AS hits, count(*) FILTER (WHERE s.key IS NULL) AS misses FROM conversations c LEFT JOIN s ON s.key = sha256(role || '|' || text) GROUP BY role"""


def vlm_degrade(spark, sf_dir):
    """Image calls until the first that the budget does not allow; all later ones keep the picture only."""
    costed = _costed(spark, sf_dir)
    stop = op.first_rejected(costed, 0.002).withColumnRenamed("seq", "stop")
    d = costed.join(stop, "run", "left").withColumn("called", F.expr("stop is null or seq < stop"))
    return d.groupBy("run").agg(F.count_if("called").alias("called"), F.count_if(F.expr("not called")).alias("image_only"))


DEGRADE = """, s AS (SELECT run, seq, sum(held) OVER w AS spent, cache_hit, sum(bill_in + bill_out) OVER w AS tokens, bool_or(price_in IS NULL AND NOT cache_hit) OVER w AS unknown FROM h
WINDOW w AS (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT run, min(seq) AS stop FROM s WHERE NOT cache_hit AND (round(spent, 9) > 0.002 OR unknown AND tokens > 2000000) GROUP BY run)
SELECT c.run, count(*) FILTER (WHERE stop IS NULL OR seq < stop) AS called, count(*) FILTER (WHERE seq >= stop) AS image_only FROM calls c LEFT JOIN t ON c.run = t.run GROUP BY c.run"""


def asset_drop(spark, sf_dir):
    return op.drop_assets(a.assets(spark, sf_dir), 60_000)


DROP = """, t AS (SELECT doc, sum(bytes) AS total FROM assets GROUP BY doc),
b AS (SELECT s.*, total, coalesce(sum(bytes) OVER (PARTITION BY s.doc ORDER BY kind = 'table', bytes DESC, asset_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
FROM assets s JOIN t ON s.doc = t.doc WHERE kind IN ('figure', 'table'))
SELECT doc, asset_id, bytes FROM b WHERE total - before > 60000"""


def bundle_size(spark, sf_dir):
    """Bytes of a bundle's parts and whether they pass the warning mark."""
    d = a.read(spark, sf_dir, "pages").groupBy(F.expr("page_id % 20 as bundle")).agg(F.sum(F.octet_length("html")).alias("bytes"))
    return d.selectExpr("bundle", "bytes", "bytes > 60000 as warn")


def rate_limit(spark, sf_dir):
    d = a.read(spark, sf_dir, "events").selectExpr("user_id % 50 as gate", "event_id as id", "unix_micros(cast(ts as timestamp)) as us")
    return op.paced(d, 300_000_000)


RATE = """WITH e AS (SELECT user_id % 50 AS gate, event_id AS id, epoch_us(ts) AS us FROM events),
i AS (SELECT *, row_number() OVER (PARTITION BY gate ORDER BY us, id) AS i FROM e)
SELECT gate, id, us, CAST(i * 300000000 + max(us - i * 300000000) OVER (PARTITION BY gate ORDER BY i) AS BIGINT) AS release_us FROM i"""


def byte_cap(spark, sf_dir):
    d = a.read(spark, sf_dir, "documents").selectExpr("source as gate", "doc_id as seq", "n_chars as bytes")
    return op.first_over(d, 50_000)


CAP = """WITH s AS (SELECT source AS gate, doc_id AS seq, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS seen FROM documents)
SELECT gate, min(seq) AS seq, CAST(arg_min(seen, seq) AS BIGINT) AS seen FROM s WHERE seen > 50000 GROUP BY gate"""


def debounce_last(spark, sf_dir):
    """The last event of each burst: bursts end where 600 s pass without an event."""
    d = a.read(spark, sf_dir, "events").selectExpr("user_id", "event_id", "unix_micros(cast(ts as timestamp)) as us")
    d = d.selectExpr("*", "lead(us) over (partition by user_id order by us, event_id) as after")
    return d.where("after is null or after - us > 600000000").select("user_id", "event_id", "us")


DEBOUNCE = """SELECT user_id, event_id, us FROM (SELECT user_id, event_id, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS after FROM events)
WHERE after IS NULL OR after - us > 600000000"""


def back_stack(spark, sf_dir):
    """The newest 50 positions of each user (the viewer's history holds 50)."""
    d = a.read(spark, sf_dir, "events").selectExpr("user_id", "event_id", "row_number() over (partition by user_id order by ts desc, event_id desc) as back")
    return d.where("back <= 50").selectExpr("user_id", "event_id", "cast(back as bigint) as back")


def format_counts(spark, sf_dir):
    return a.read(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("chars")).select("source", op.short_count(F.col("chars")).alias("shown"))


FORMAT = """SELECT source, CASE WHEN s >= 1000000 THEN printf('%g', s / 1e6) || 'M' WHEN s >= 1000 THEN printf('%g', s / 1e3) || 'k' ELSE CAST(s AS VARCHAR) END AS shown
FROM (SELECT source, sum(n_chars) AS s FROM documents GROUP BY source)"""


def _calls(tail):
    return a.with_sql("calls", PRICE_SQL + COSTED + tail)


ENTRIES = {
    "cost_estimate": Entry(cost_estimate, ESTIMATE),
    "ledger_rollup": Entry(ledger_rollup, _calls(" SELECT run, count(*) AS calls, count(*) FILTER (WHERE cache_hit) AS cache_hits, CAST(sum(bill_in) AS BIGINT) AS tokens_in, CAST(sum(bill_out) AS BIGINT) AS tokens_out, round(CASE WHEN count(*) FILTER (WHERE price_in IS NULL AND NOT cache_hit) = 0 THEN coalesce(sum(usd), 0) END, 9) AS usd FROM h GROUP BY run")),
    "ledger_stop": Entry(ledger_stop, _calls(STOP)),
    "request_key": Entry(request_key, "SELECT conv_id, turn, sha256(role || '|' || text || '|v1') AS key FROM conversations"),
    "cache_hit_split": Entry(cache_hit_split, SPLIT),
    "vlm_degrade": Entry(vlm_degrade, _calls(DEGRADE)),
    "asset_drop": Entry(asset_drop, a.with_sql("assets", DROP)),
    "bundle_size": Entry(bundle_size, "SELECT page_id % 20 AS bundle, CAST(sum(octet_length(encode(html))) AS BIGINT) AS bytes, sum(octet_length(encode(html))) > 60000 AS warn FROM pages GROUP BY 1"),
    "rate_limit": Entry(rate_limit, RATE),
    "byte_cap": Entry(byte_cap, CAP),
    "debounce_last": Entry(debounce_last, DEBOUNCE),
    "back_stack": Entry(back_stack, "SELECT * FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events) WHERE back <= 50"),
    "format_counts": Entry(format_counts, FORMAT),
}
