"""Timing, usage and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.barrier import compute_once
from .ranking import split_running_sum

LOG_LINE = r"^(\S+) (\S+) -> (\d+) in (\d+(?:\.\d+)?)ms$"


def parse_request_log(lines: DataFrame, col: str, keep: list[str] | None = None) -> DataFrame:
    """``METHOD path -> status in N.NNms`` to columns; other lines are left out."""
    # One match tells a request; a request has no other blanks than those between its words.
    requests = lines.filter(F.col(col).rlike(LOG_LINE))
    words = compute_once(requests, keep or [], F.split(col, " "), "__w")
    word = [F.get("__w", F.lit(i)) for i in range(6)]
    return words.select(
        *(keep or []),
        word[0].alias("method"),
        word[1].alias("path"),
        word[3].cast("int").alias("status"),
        F.regexp_replace(word[5], "ms$", "").cast("double").alias("ms"),
    )


PERCENTS = (50, 95, 99)


def request_timing(
    lines: DataFrame, col: str, exact: bool = False, accuracy: int = 10_000
) -> DataFrame:
    """Counts, mean, percentiles and share of server errors per route.

    By default percentiles come from sketches, right within one rank of ``accuracy``, and are named
    ``p95_ms_approx``. With ``exact`` they are interpolated from the counts of all durations and named ``p95_ms``.
    """
    requests = parse_request_log(lines, col)
    route = ["method", "path"]
    sums = [F.count("*").alias("n"), F.avg("ms").alias("mean_ms")]
    errors = (F.count_if(F.col("status") >= 500) / F.count("*")).alias("error_share")
    if not exact:
        sketches = [
            F.percentile_approx("ms", F.lit(p / 100), F.lit(accuracy)).alias(f"p{p}_ms_approx")
            for p in PERCENTS
        ]
        return requests.groupBy(*route).agg(*sums, *sketches, errors)
    return requests.groupBy(*route).agg(*sums, errors).join(_percentiles(requests, route, "ms"), route)


SKETCH_K = 800  # size of a stored sketch; ranks are then right within half a per cent, with 99 % confidence


def timing_sketches(requests: DataFrame, at: str = "ts", unit: str = "day", k: int = SKETCH_K) -> DataFrame:
    """Parsed requests summed up per route and ``unit`` of time, with a KLL sketch of the durations, to be stored.

    (method, path, period, n, total_ms, errors, sketch). Combined map-side; a sketch has a few kilobytes, whatever
    it has seen.
    """
    return requests.groupBy("method", "path", F.date_trunc(unit, F.col(at)).alias("period")).agg(
        F.count("*").alias("n"),
        F.sum("ms").alias("total_ms"),
        F.count_if(F.col("status") >= 500).alias("errors"),
        F.kll_sketch_agg_double("ms", k).alias("sketch"),
    )


def timing_over(stored: DataFrame, percents: tuple[int, ...] = PERCENTS) -> DataFrame:
    """Timing per route over the stored periods that are given, whichever and however many: counts and sums
    are added up, sketches merged. Percentiles are right within the rank error of the sketches and named ``p95_ms_kll``."""
    merged = stored.groupBy("method", "path").agg(
        F.sum("n").alias("n"),
        (F.sum("total_ms") / F.sum("n")).alias("mean_ms"),
        (F.sum("errors") / F.sum("n")).alias("error_share"),
        F.kll_merge_agg_double("sketch").alias("__s"),
    )
    quantiles = [F.kll_sketch_get_quantile_double("__s", F.lit(p / 100)).alias(f"p{p}_ms_kll") for p in percents]
    return merged.select("method", "path", "n", "mean_ms", *quantiles, "error_share")


def _percentiles(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Interpolated percentiles per key. Values are counted first and the counts are summed up in
    range partitions, so a key with very many values is spread over tasks."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    running = split_running_sum(counts, keys, [F.col(value).asc()], "__n", "__upto")
    totals = counts.groupBy(*keys).agg(F.sum("__n").alias("__all"))
    placed = running.join(totals, keys)

    def at(place: Column) -> Column:
        """The value of the given rank, from 0."""
        return F.min(F.when(F.col("__upto") > place, F.col(value)))

    places = {p: (F.col("__all") - 1) * p / 100 for p in PERCENTS}
    ends = [
        x
        for p, place in places.items()
        for x in (at(F.floor(place)).alias(f"__lo{p}"), at(F.ceil(place)).alias(f"__hi{p}"))
    ]
    found = placed.groupBy(*keys, "__all").agg(*ends)
    return found.select(
        *keys,
        *[
            (
                F.col(f"__lo{p}")
                + (F.col(f"__hi{p}") - F.col(f"__lo{p}")) * (place - F.floor(place))
            ).alias(f"p{p}_ms")
            for p, place in places.items()
        ],
    )


def stage_timing(traces: DataFrame, stages: dict[str, str]) -> DataFrame:
    """Seconds per stage over all traces and the stage's share of the total.

    ``stages`` maps a label to its seconds column. One global row of sums, then unpivoted; the
    aggregation ends in one row whatever the number of traces.
    """
    sums = traces.agg(*[F.sum(c).alias(s) for s, c in stages.items()])
    rows = F.array(
        *[F.struct(F.lit(s).alias("stage"), F.col(s).alias("seconds")) for s in stages]
    )
    total = F.aggregate(
        F.array(*[F.coalesce(F.col(s).cast("double"), F.lit(0.0)) for s in stages]),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    return sums.select(total.alias("total_seconds"), F.inline(rows)).select(
        "stage",
        "seconds",
        "total_seconds",
        (F.col("seconds") / F.nullif(F.col("total_seconds"), F.lit(0.0))).alias("share"),
    )


def run_duration(runs: DataFrame, keys: list[str], cube: bool = False) -> DataFrame:
    """Runs, total and mean duration (seconds to one decimal) per key, or over their cube."""
    grouped = runs.cube(*keys) if cube else runs.groupBy(*keys)
    return grouped.agg(
        F.count("*").alias("n_runs"),
        F.sum("duration_ms").alias("total_ms"),
        F.round(F.sum("duration_ms") / F.count("*") / 1000, 1).alias("mean_seconds"),
    )


def token_totals(usage: DataFrame) -> DataFrame:
    """Tokens per model, prompt version and day."""
    return usage.groupBy(
        "model", "prompt_version", F.to_date("created_at").alias("day")
    ).agg(
        F.count("*").alias("n_calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
    )


def cost_and_margin(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost, cost per page, revenue and margin per model and month.

    ``usage``: model, created_at, pages, input_units, output_units. ``prices``: model, in_price,
    out_price (per unit), page_price (revenue per page). Usage is reduced to one row per model
    and month before it meets the prices, so the join is small on both sides. Usage of a model without a
    price stays, with null amounts and ``is_priced`` false. Money is DECIMAL,
    ratios are DOUBLE.
    """
    monthly = usage.groupBy("model", F.date_trunc("month", "created_at").alias("month")).agg(
        F.sum("pages").alias("pages"),
        F.sum("input_units").alias("input_units"),
        F.sum("output_units").alias("output_units"),
    )
    money = "decimal(38,6)"
    cost = (
        F.col("input_units") * F.col("in_price") + F.col("output_units") * F.col("out_price")
    ).cast(money)
    revenue = (F.col("pages") * F.col("page_price")).cast(money)
    known = prices.withColumn("__priced", F.lit(True))
    priced = monthly.join(known, "model", "left").select(
        "model", "month", "pages", cost.alias("cost"), revenue.alias("revenue"),
        F.coalesce("__priced", F.lit(False)).alias("is_priced"),
    )
    margin = F.col("revenue") - F.col("cost")
    return priced.select(
        *[c for c in priced.columns if c != "is_priced"],
        (F.col("cost").cast("double") / F.nullif(F.col("pages"), F.lit(0))).alias("cost_per_page"),
        margin.alias("margin"),
        (
            margin.cast("double") * 100 / F.nullif(F.col("revenue").cast("double"), F.lit(0.0))
        ).alias("margin_pct"),
        "is_priced",
    )


def throughput(runs: DataFrame, demand_per_hour: float) -> DataFrame:
    """Pages per hour and headroom over demand, per model and day.

    ``runs``: model, created_at, pages, duration_ms.
    """
    daily = runs.groupBy("model", F.to_date("created_at").alias("day")).agg(
        F.sum("pages").alias("pages"), F.sum("duration_ms").alias("duration_ms")
    )
    seconds = F.nullif(F.col("duration_ms") / 1000, F.lit(0.0))
    return daily.withColumn("pages_per_hour", F.col("pages") * 3600 / seconds).withColumn(
        "headroom", F.col("pages_per_hour") / demand_per_hour
    )
