"""Ledgers, estimates, budgets and rate limits as aggregates and prefix windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Price per million tokens held back for a model without a known price (fixed values).
UNKNOWN_IN, UNKNOWN_OUT = 10.0, 30.0
UNPRICED_TOKENS = 2_000_000


def estimate(runs: DataFrame, pricing: DataFrame, chars_per_token: float = 4.0, image_tokens: int = 1100) -> DataFrame:
    """Calls, tokens and price of a run before it starts; (run, model, vision_model, pages, chars, equations) in.

    A text takes two bibliography calls; without pages there is no segmentation, so its characters cost
    nothing else. Images are priced by the vision model; a price that is missing leaves the sum unknown.
    """
    d = runs.selectExpr("*", "cast(ceil(pages / 8.0D) as bigint) as seg_calls", "case when chars > 0 then 2L else 0L end as bib_calls", f"equations * ({image_tokens}L + 200) as image_in", "equations * 1024L as image_out")
    d = d.selectExpr("*", f"case when seg_calls > 0 then cast(ceil(chars / {chars_per_token}D) as bigint) + 500 * seg_calls else 0L end as seg_in")
    d = d.selectExpr("*", "seg_in + 500 * bib_calls as text_in", "seg_calls * least(seg_in div greatest(seg_calls, 1), 4096) + bib_calls * least(greatest(500L, cast(chars as bigint) div 20), 4096) as text_out")
    vision = pricing.selectExpr("model as vision_model", "price_in as image_price_in", "price_out as image_price_out")
    d = d.join(pricing, "model", "left").join(vision, "vision_model", "left")
    usd = "text_in * price_in + text_out * price_out + case when equations > 0 then image_in * image_price_in + image_out * image_price_out else 0 end"
    return d.selectExpr("run", "model", "seg_calls + equations + bib_calls as calls", "text_in + image_in as tokens_in", "text_out + image_out as tokens_out", f"round(({usd}) / 1e6D, 6) as usd")


def cost(calls: DataFrame, pricing: DataFrame) -> DataFrame:
    """Adds billable tokens (none for cache hits), the held cost and the true cost (null if the price is unknown)."""
    d = calls.join(pricing, "model", "left")
    d = d.selectExpr("*", "case when cache_hit then 0L else prompt_tokens end as bill_in", "case when cache_hit then 0L else completion_tokens end as bill_out")
    held = f"(bill_in * coalesce(price_in, {UNKNOWN_IN}D) + bill_out * coalesce(price_out, {UNKNOWN_OUT}D)) / 1e6D"
    return d.selectExpr("*", "price_in is null and not cache_hit as unpriced", f"{held} as held_usd", "(bill_in * price_in + bill_out * price_out) / 1e6D as usd")


def rollup(costed: DataFrame) -> DataFrame:
    """Sums of a run; its cost is unknown as soon as one call that was no cache hit has no price."""
    return costed.groupBy("run").agg(
        F.count("*").alias("calls"), F.count_if("cache_hit").alias("cache_hits"), F.sum("bill_in").alias("tokens_in"), F.sum("bill_out").alias("tokens_out"),
        F.round(F.when(F.bool_or("unpriced"), None).otherwise(F.coalesce(F.sum("usd"), F.lit(0.0))), 9).alias("usd"),
    )


def first_rejected(costed: DataFrame, limit_usd: float, unpriced_limit: int = UNPRICED_TOKENS) -> DataFrame:
    """(run, seq) of the first call that would pass the limit (strictly).

    From the first call without a price on, all tokens of the run count against ``unpriced_limit``.
    Cache hits send nothing and are not checked.
    """
    w = "over (partition by run order by seq rows between unbounded preceding and current row)"
    d = costed.selectExpr("*", f"sum(held_usd) {w} as spent", f"sum(bill_in + bill_out) {w} as tokens", f"max(unpriced) {w} as unknown")
    return d.where(f"not cache_hit and (round(spent, 9) > {limit_usd}D or unknown and tokens > {unpriced_limit})").groupBy("run").agg(F.min("seq").alias("seq"))


def drop_assets(assets: DataFrame, cap: int) -> DataFrame:
    """(doc, asset_id, bytes) of assets that go: figures, then tables, largest first, while the total is over the cap."""
    total = assets.groupBy("doc").agg(F.sum("bytes").alias("total"))
    d = assets.where("kind in ('figure', 'table')").join(total, "doc")
    d = d.selectExpr("*", "coalesce(sum(bytes) over (partition by doc order by kind = 'table', bytes desc, asset_id rows between unbounded preceding and 1 preceding), 0L) as before")
    return d.where(F.col("total") - F.col("before") > cap).select("doc", "asset_id", "bytes")


def paced(requests: DataFrame, interval_us: int) -> DataFrame:
    """Adds ``release_us``: at least the interval after the release before.

    t'(i) = max(t(i), t'(i-1) + d) in closed form: i * d + max over j <= i of t(j) - j * d.
    """
    d = requests.selectExpr("*", "row_number() over (partition by gate order by us, id) as i")
    return d.selectExpr("*", f"i * {interval_us}L + max(us - i * {interval_us}L) over (partition by gate order by i rows between unbounded preceding and current row) as release_us").drop("i")


def first_over(stream: DataFrame, cap: int) -> DataFrame:
    """(gate, seq, seen) of the first piece that takes a stream over its cap."""
    d = stream.selectExpr("*", "sum(bytes) over (partition by gate order by seq rows between unbounded preceding and current row) as seen")
    return d.where(F.col("seen") > cap).groupBy("gate").agg(F.min_by(F.struct("seq", "seen"), "seq").alias("x")).selectExpr("gate", "x.seq as seq", "x.seen as seen")


def short_count(n: Column) -> Column:
    """12, 1.5k, 12.3457M, 1.23457e+06M: six significant digits as C's %g gives them, without trailing zeros.

    Millions are rounded by the exact value of the double, halves to the even digit. format_string rounds the
    shortest decimal form, halves up: 1188945 would be 1.18895M, but the double nearest to 1.188945 is below it.
    """

    def let(value: Column, then: Callable[[Column], Column]) -> Column:
        return F.transform(F.array(value), then)[0]

    def power(k: Column) -> Column:
        return F.rpad(F.lit("1"), 1 + F.greatest(k, F.lit(0)), "0").cast("decimal(8,0)")

    def rounded(v: Column) -> Column:
        """(six digits as one number, decimal exponent); a double from 1 on is a whole number of 2^-52, so all is exact."""
        whole, unit = F.floor(v), F.lit(2**52).cast("decimal(16,0)")
        units = whole.cast("decimal(13,0)") * unit + ((v - whole) * float(2**52)).cast("long").cast("decimal(16,0)")
        over = F.length(whole.cast("string")) - 6
        cut = let(F.struct((units * power(-over)).alias("a"), (unit * power(over)).alias("b"), over.alias("over")), lambda x: F.struct(F.call_function("div", x["a"], x["b"]).alias("q"), ((x["a"] % x["b"]) * 2).alias("r"), x["b"].alias("b"), x["over"].alias("over")))
        up = let(cut, lambda x: F.struct((x["q"] + ((x["r"] > x["b"]) | (x["r"] == x["b"]) & (x["q"] % 2 == 1)).cast("long")).alias("q"), (x["over"] + 5).alias("e")))
        return let(up, lambda x: F.when(x["q"] == 1_000_000, F.struct(F.lit(100_000).cast("long").alias("q"), (x["e"] + 1).alias("e"))).otherwise(x))

    def point(digits: Column, at: Column) -> Column:
        return F.concat(F.substring(digits, F.lit(1), at), F.regexp_replace(F.concat(F.lit("."), F.substring(digits, at + 1, F.lit(6))), r"\.?0*$", ""))

    def shown(x: Column) -> Column:
        digits = x["q"].cast("string")
        return F.when(x["e"] < 6, point(digits, x["e"] + 1)).otherwise(F.concat(point(digits, F.lit(1)), F.lit("e+"), F.lpad(x["e"].cast("string"), 2, "0")))

    thousands = point(n.cast("string"), F.length(n.cast("string")) - 3)
    return F.when(n >= 1_000_000, F.concat(let(rounded(n / 1e6), shown), F.lit("M"))).when(n >= 1000, F.concat(thousands, F.lit("k"))).otherwise(n.cast("string"))
