"""Run diagnostics: status and route histograms, latencies, outliers, concurrency, request counts, error classes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------
STATUSES = ("translated", "partially_translated", "kept_origin", "failed")
ALLOWED_ROUTES = ("fast_path_keep_origin",)
ALLOWED_REASONS = ("code", "keep_origin", "no_trans", "skip_display_formula", "skip_model_keep_origin")
SLOW_MS, SLOW_SAMPLES = 30000, 12
PERCENTILES = (0.5, 0.9, 0.95)
TIMEOUTS = ("ReadTimeout", "ConnectTimeout", "Timeout")
OCR_STAGES = ("ocr_upload", "ocr_processing", "ocr_result_ready", "normalizing")
TRANSLATE_STAGES = ("translation_prepare", "translating", "translation_batches", "continuation_review", "page_policies", "domain_inference", "garbled_repair")
RENDER_STAGES = ("render_prepare", "rendering", "compile", "overlay", "saving")
PAGE_STAGES = ("ocr_processing", "continuation_review", "page_policies", "domain_inference", "garbled_repair", "rendering")
STEP_STAGES = ("compile", "overlay", "saving", "render_prepare", "translation_prepare", "normalizing")
REQUEST_STAGES = (
    ("book: batch", "translation"), ("classification page", "classification"), ("continuation-review", "continuation_review"), ("mixed-split", "mixed_literal_split"),
    ("garbled-reconstruct", "garbled_reconstruction"), ("domain-infer", "domain_context"),
)
# -----------------------------------------------------------------------------


def _has(c: Column, *needles: str) -> Column:
    out = c.contains(needles[0])
    for n in needles[1:]:
        out = out | c.contains(n)
    return out


def error_taxonomy(message: Column, status_code: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(status_code == 429, "rate_limit").when(status_code >= 500, "transport").when(_has(low, "429", "rate limit", "retry-after"), "rate_limit")
        .when(_has(low, "timeout", "connection", "http", "transport"), "transport").when(_has(low, "refusal", "refused", "safety"), "refusal")
        .when(_has(low, "placeholder", "segment", "validation", "inventory"), "validation").otherwise("protocol")
    )


def request_stage(label: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    out = F.when(low == "", "unspecified")
    for prefix, stage in REQUEST_STAGES:
        out = out.when(low.startswith(prefix), stage)
    return out.when(low.contains(" typst-repair") | low.startswith("typst-repair"), "typst_repair").otherwise("other_llm")


def user_stage(stage: Column) -> Column:
    s = F.trim(F.coalesce(stage, F.lit("")))
    return F.when(s.isin(*OCR_STAGES), "ocr").when(s.isin(*TRANSLATE_STAGES), "translate").when(s.isin(*RENDER_STAGES), "render").when(s.isin("finished", "done"), "done").otherwise("")


def progress_unit(stage: Column, event_type: Column, explicit: Column) -> Column:
    s, e = F.trim(F.coalesce(stage, F.lit(""))), F.trim(F.coalesce(explicit, F.lit("")))
    step = s.isin(*STEP_STAGES) | (F.trim(F.coalesce(event_type, F.lit(""))) == "stage_progress")
    return F.when(e != "", e).when(s.isin("translating", "translation_batches"), "batch").when(s.isin(*PAGE_STAGES), "page").when(step, "step").otherwise("none")


def settled_status(item_status: Column, diagnosed: Column, has_text: Column) -> Column:
    """The diagnosed status, but the item's own where that is not ``translated`` and there is no text; ``translated`` by default."""
    own, seen = F.trim(F.coalesce(item_status, F.lit(""))), F.trim(F.coalesce(diagnosed, F.lit("")))
    found = F.when(~has_text & ~own.isin("", "translated"), own).otherwise(F.when(seen != "", seen).otherwise(own))
    return F.when(found == "", "translated").otherwise(found)


def is_blocking(status: Column, routes: Column, reasons: Column) -> Column:
    """Kept or failed without an allowed route or reason."""
    lits = lambda v: F.array(*[F.lit(x) for x in v])
    return status.isin("kept_origin", "failed") & ~F.arrays_overlap(routes, lits(ALLOWED_ROUTES)) & ~F.arrays_overlap(reasons, lits(ALLOWED_REASONS))


def status_summary(rows: DataFrame, *keys: str) -> DataFrame:
    """One column per status; zero where there are none."""
    return rows.groupBy(*keys).agg(*[F.count(F.when(F.col("final_status") == s, 1)).alias(s) for s in STATUSES], F.count(F.when(F.col("blocking"), 1)).alias("unresolved"))


def route_summary(rows: DataFrame) -> DataFrame:
    """(route, n, success_rate) over exploded route paths, blank ones left out."""
    each = rows.select(F.explode("route_path").alias("route"), "final_status").where("route <> ''")
    won = F.count(F.when(F.col("final_status").isin("translated", "partially_translated"), 1))
    return each.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.round(won / F.count(F.lit(1)), 4).alias("success_rate"))


def latency_summary(rows: DataFrame, keys: list[str], value: str = "latency_ms") -> DataFrame:
    """count, min, p50, p90, p95, max, mean: percentiles interpolate linearly and round to whole numbers (halves to even).

    Values are counted before they are put in order.  A percentile between two values is low * (1 - d) + high * d with the first product not
    rounded, as SQL's quantile_cont has it: that decides where it lies half way between two whole numbers.
    """
    v, to = F.col("__v"), F.col("__to")
    counted = rows.groupBy(*keys, F.col(value).alias("__v")).agg(F.count(value).alias("__c"))
    w = Window.partitionBy(*keys)
    placed = counted.withColumn("__to", F.sum("__c").over(w.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.sum("__c").over(w))
    place = lambda q: (F.col("__n") - 1) * F.lit(q)
    ends = [F.min(F.when(to > edge(place(q)), v)).alias(f"{name}{k}") for k, q in enumerate(PERCENTILES) for edge, name in ((F.floor, "__low"), (F.ceil, "__high"))]
    agg = placed.groupBy(*keys, "__n").agg(F.min(v).alias("min"), F.max(v).alias("max"), F.sum(v.cast("double") * F.col("__c")).alias("__sum"), *ends)

    def percentile(k: int) -> Column:
        low, high, d = F.col(f"__low{k}").cast("double"), F.col(f"__high{k}").cast("double"), place(PERCENTILES[k]) - F.floor(place(PERCENTILES[k]))
        return F.when(low.isNotNull(), F.reflect(F.lit("java.lang.Math"), F.lit("fma"), low, 1 - d, high * d).cast("double"))

    mean = F.round(F.col("__sum") / F.col("__n") * 100) / 100
    return agg.select(*keys, F.col("__n").alias("n"), "min", *[F.bround(percentile(k)).cast("long").alias(f"p{round(q * 100)}") for k, q in enumerate(PERCENTILES)], "max", mean.alias("mean"))


def latency_outliers(rows: DataFrame, keys: list[str], floor_ms: int = SLOW_MS, value: str = "latency_ms") -> DataFrame:
    """Rows over max(floor, mean + 2 population standard deviations) of the positive latencies of their group."""
    v = F.when(F.col(value) > 0, F.col(value))
    limits = rows.groupBy(*keys).agg(F.greatest(F.lit(floor_ms), F.floor(F.avg(v) + 2 * F.stddev_pop(v))).cast("long").alias("threshold_ms"))
    return rows.join(limits, keys).where(F.col(value) > F.col("threshold_ms"))


def slow_requests(rows: DataFrame, keys: list[str], value: str = "latency_ms", tie: str = "event_id", most: int = SLOW_SAMPLES) -> DataFrame:
    """The slowest ``most`` requests of each group (a top-k report)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value), tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def peak_inflight(requests: DataFrame, keys: list[str], start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """The largest number of requests open at once; one that ends when another starts has ended."""
    points = requests.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("p")).select(*keys, "p.t", "p.d")
    sums = points.groupBy(*keys, "t").agg(F.sum(F.when(F.col("d") < 0, -1).otherwise(0)).alias("down"), F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).alias("up"))
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return sums.withColumn("open", F.sum(F.col("up") + F.col("down")).over(w)).groupBy(*keys).agg(F.max("open").alias("peak"))


def request_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Attempts by outcome: a failure is a timeout, else an HTTP error if it has a status code, else an exception."""
    n = lambda c: F.count(F.when(c, 1))
    failed, timeout = ~F.col("success"), F.trim(F.coalesce("error_class", F.lit(""))).isin(*TIMEOUTS)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_http_attempts"), n(F.col("success")).alias("succeeded_attempts"), n(failed).alias("failed_attempts"), n(F.col("attempt") > 1).alias("retried_attempts"),
        n(failed & timeout).alias("timeout_attempts"), n(failed & ~timeout & F.col("status_code").isNotNull()).alias("http_error_attempts"), n(failed & ~timeout & F.col("status_code").isNull()).alias("request_exception_attempts"),
    )


def stage_durations(events: DataFrame, job: str, order: list[str]) -> DataFrame:
    """(job, stage, enter_ms, exit_ms, duration_ms, visits) of maximal runs of one stage; the last run of a job is still open (null)."""
    w = Window.partitionBy(job).orderBy(*order)
    marked = events.withColumn("__new", F.coalesce((F.lag("stage").over(w) != F.col("stage")).cast("int"), F.lit(1))).withColumn("run", F.sum("__new").over(w))
    runs = marked.groupBy(job, "run", "stage").agg(F.min("ts_ms").alias("enter_ms"))
    exit_ms = F.lead("enter_ms").over(Window.partitionBy(job).orderBy("run"))
    return runs.withColumn("exit_ms", exit_ms).withColumn("duration_ms", F.col("exit_ms") - F.col("enter_ms"))


def adaptive_limit(requests: DataFrame, keys: list[str], order: list[str], workers: int) -> DataFrame:
    """(keys..., final_limit, peak_limit, n) of the concurrency controller over each group's requests in order.

    Halves after an overloaded or timed-out failure, falls by one after a success of 90 s or more, rises by one after 12 successes in a
    row of which the last took 15 s or less.  Each step depends on the last, so a group is folded in order, in Arrow chunks.
    """
    least, most = max(1, min(8, workers)), max(1, workers)

    def fold(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limit, peak, streak, n, key = most, most, 0, 0, None
        for part in chunks:
            key = [part[k].iloc[0] for k in keys]
            for ok, ms, code, error in zip(part["success"], part["latency_ms"], part["status_code"], part["error_class"], strict=True):
                n += 1
                if not ok:
                    if error in (*TIMEOUTS, "ConnectionError") or code in (408, 429, 500, 502, 503, 504):
                        limit, streak = max(least, limit // 2), 0
                elif ms >= 90000:
                    limit, streak = max(least, limit - 1), 0
                else:
                    streak += 1
                    if ms <= 15000 and streak >= 12 and limit < most:
                        limit, streak = limit + 1, 0
                        peak = max(peak, limit)
        yield pd.DataFrame([[*key, limit, peak, n]], columns=[*keys, "final_limit", "peak_limit", "n"])

    types = dict(requests.dtypes)
    whole = lambda parts: pd.concat(list(fold(parts)))
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], "final_limit long", "peak_limit long", "n long"])
    return requests.groupBy(*keys).applyInPandas(lambda part: whole(iter([part.sort_values(order)])), schema)


def debug_search(rows: DataFrame, page: int | None = None, status: str | None = None, error: str | None = None, route: str | None = None, text: str | None = None) -> DataFrame:
    """Optional filters that all must hold; names compare caselessly, text is looked for in id, source and translation previews."""
    low = lambda v: v.strip().lower() if v and v.strip() else None
    if page is not None:
        rows = rows.where(F.col("page_number") == page)
    if low(status):
        rows = rows.where(F.lower("final_status") == low(status))
    if low(error):
        rows = rows.where(F.exists("error_types", lambda e: F.lower(e) == low(error)))
    if low(route):
        rows = rows.where(F.exists("route_path", lambda r: F.lower(r).contains(low(route))))
    if low(text):
        rows = rows.where(F.lower("item_id").contains(low(text)) | F.lower("source_preview").contains(low(text)) | F.lower("translated_preview").contains(low(text)))
    return rows
