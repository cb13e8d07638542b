"""Leading of bodies that don't fill their box, and blocks that hold far more text than their box: native Columns and windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as T
from quire.operators.outputs import let

# --- fixed values ------------------------------------------------------------
LEADING_LEAST, LEADING_MOST, COMFORT_LEAST, COMFORT_MOST, LONG_MOST, LONG_MOST_NO_SOURCE, FEW_LINES_MOST = 0.44, 0.68, 0.56, 1.02, 0.76, 0.74, 0.70
DENSITY_MOST, DENSITY_TRIGGER, TARGET, TARGET_NO_SOURCE, TARGET_SHORT, TARGET_FEW_LINES, FEW_LINES, LONG_LINES = 0.985, 0.60, 0.80, 0.68, 0.72, 0.78, 5, 9
ITERATIONS, TOLERANCE, BRACKET, FRACTION = 6, 0.002, 0.005, (0.12, 0.88)
GAIN_MOST, GAIN_RATE, LINE_RATE, BASE_MOST, SOURCE_MOST, LONG_TEXT_MOST, PENALTY_MOST, AFTER_GROWTH, LINES_BASE, LINES_RATE = 0.12, 1.8, 0.42, 0.10, 0.28, 0.08, 0.20, 0.04, 2.0, 2.1
VOLUME_BASE, VOLUME_RATE, PITCH_RATE, LONG_CAP_RATE, SOURCE_CAP_RATE, PITCH_CAP_RATE = 6.0, 0.45, 3.2, 0.38, 0.7, 1.1
GLUED_CHARS, GLUED_RATIO, GLUED_GAP, GLUED_OVERLAP, GLUED_OVERFLOW, COLLISION_GAP = 1000, 15.0, 28.0, 0.6, 1.25, 0.9
# -----------------------------------------------------------------------------


def _rise(value: Column, rate: float) -> Column:
    """From 0 towards 1."""
    return 1.0 - F.exp(F.greatest(F.lit(0.0), value) * -rate)


def _clamp(value: Column, low, high) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.greatest(lit(low), F.least(lit(high), value))


def secant(density: Callable[[Column], Column], low: Column, high: Column, target: Column) -> Column:
    """The largest leading found between ``low`` and ``high`` whose density stays under ``target``: regula falsi with bounded steps, at most six of them.

    A fold with the bracket, its residuals and the best value so far as state; it stops within the tolerance or when the bracket is small.
    """
    names = ("low", "high", "low_res", "high_res", "best")
    start = F.struct(*[c.cast("double").alias(n) for c, n in zip((low, high, target - density(low), target - density(high), low), names, strict=True)], F.lit(False).alias("done"))

    def state(c: Column, done: Column, **new: Column) -> Column:
        return F.struct(*[new.get(n, c[n]).alias(n) for n in names], done.alias("done"))

    def step(c: Column, _: Column) -> Column:
        span = c["low_res"] - c["high_res"]
        at = F.when(F.abs(span) <= 1e-9, 0.5).otherwise(_clamp(c["low_res"] / span, *FRACTION))

        def tried(trial: Column) -> Column:
            def judged(d: Column) -> Column:
                rest = target - d
                good = (d <= DENSITY_MOST) & (rest >= 0)
                near = F.abs(rest) <= TOLERANCE
                no = F.lit(False)
                return F.when(near, state(c, F.lit(True), best=F.when(good, trial).otherwise(c["best"]))).when(good, state(c, no, best=trial, low=trial, low_res=rest)).otherwise(state(c, no, high=trial, high_res=rest))

            return let(density(trial), judged)

        open_ = ~c["done"] & (c["high"] - c["low"] > BRACKET)
        return F.when(open_, let(c["low"] + (c["high"] - c["low"]) * at, tried)).otherwise(state(c, F.lit(True)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ITERATIONS)), start, step)["best"]


def solved_leading(blocks: DataFrame) -> DataFrame:
    """blocks plus solution (leading_em, target_density, leading_cap_em): the leading that fills an underfilled body better; null where nothing is to be gained.

    ``blocks``: font, leading (null: the least), needed (lines of the text in the box), height (that counts for density), discount, source_lines, has_lines, pitch (0: unknown), grown (points that the font has grown).
    The cap follows the lines needed, the source's lines and its pitch; growth has a budget that font growth has partly spent.
    """
    font, needed, source_lines, grown = F.col("font"), F.col("needed"), F.coalesce("source_lines", F.lit(0)), F.greatest(F.lit(0.0), F.coalesce("grown", F.lit(0.0)))
    has_lines, pitch = F.coalesce("has_lines", F.lit(False)), F.coalesce("pitch", F.lit(0.0))
    height = F.greatest(F.lit(8.0), F.col("height"))
    density = lambda ld: needed * F.greatest(font * 1.02, font * (ld + 1.0)) * F.col("discount") / height
    source = F.when(pitch > 0, _clamp(pitch / F.greatest(F.lit(0.1), font) - 1.0, 0.0, COMFORT_MOST)).otherwise(0.0)
    few = has_lines & (source_lines > 0) & (source_lines <= FEW_LINES)
    long_cap = _rise(needed - LONG_LINES + 1.0, LONG_CAP_RATE) * (F.when(source_lines <= 0, LONG_MOST_NO_SOURCE).otherwise(LONG_MOST) - LEADING_MOST)
    source_cap = _rise(source_lines / F.greatest(F.lit(1), needed) - 1.0, SOURCE_CAP_RATE) * (COMFORT_MOST - LEADING_MOST)
    pitch_cap = _rise(source, PITCH_CAP_RATE) * (COMFORT_MOST - LEADING_MOST)
    cap = F.when(few, FEW_LINES_MOST).when(needed <= 1, LEADING_MOST).otherwise(_clamp(F.greatest(long_cap, source_cap, pitch_cap) + LEADING_MOST, COMFORT_LEAST, COMFORT_MOST))
    own = F.coalesce("leading", F.lit(0.0))
    low = F.when(own == 0, LEADING_LEAST).otherwise(own)
    high = F.greatest(low, cap)
    weight = _rise(needed - 1.0, LINE_RATE)
    paired = F.when(grown <= 0, low).otherwise(_clamp(low + _rise(grown, GAIN_RATE) * GAIN_MOST * weight, low, high))
    target = F.least(F.lit(DENSITY_MOST), F.when(needed <= 2, TARGET_SHORT).when(~has_lines, TARGET_NO_SOURCE).when(few, min(TARGET, TARGET_FEW_LINES)).otherwise(TARGET))
    pressure = F.greatest(F.when(has_lines, _rise(source_lines - VOLUME_BASE, VOLUME_RATE)).otherwise(0.0), _rise(source - COMFORT_LEAST, PITCH_RATE))
    spent = weight * BASE_MOST + _rise(needed - LINES_BASE, LINES_RATE) * LONG_TEXT_MOST + pressure * SOURCE_MOST - _rise(grown, GAIN_RATE) * PENALTY_MOST
    budget = F.greatest(F.when(grown > 0, AFTER_GROWTH).otherwise(0.0), spent)
    rows = blocks.withColumns({"__low": low, "__high": high, "__paired": paired, "__target": target, "__cap": cap, "__budget": budget})
    top = F.greatest(F.col("__paired"), F.least(F.col("__high"), F.col("__low") + F.col("__budget")))
    able = (density(own) <= DENSITY_MOST) & (density(own) < DENSITY_TRIGGER) & (density(F.col("__paired")) < F.col("__target"))
    best = secant(density, F.col("__paired"), top, F.col("__target"))
    solution = F.struct(F.round(F.greatest(own, best), 2).alias("leading_em"), F.round("__target", 3).alias("target_density"), F.round("__cap", 2).alias("leading_cap_em"))
    return rows.withColumn("solution", F.when(able, solution)).drop("__low", "__high", "__paired", "__target", "__cap", "__budget")


def glued_blocks(blocks: DataFrame, page: list[str]) -> DataFrame:
    """Blocks whose text can't be theirs: much text in a low box, and set it would run far into the next block, which follows closely in the column.

    ``blocks``: page..., id, r, source, rendered, grouped, direct_math, with_formulas, font, leading, units, discount; text blocks only.  Blocks follow one another by (top, left, id); those without a rendered text are passed over.
    Returns page..., id, next_id and the figures; such a block's rendered text is dropped.
    """
    r, n = F.col("r"), F.col("__n")
    w = Window.partitionBy(*page).orderBy(r["y0"], r["x0"], "id")
    chars = F.length(F.regexp_replace(F.coalesce("source", F.lit("")), T.SPACES, ""))
    height = F.greatest(F.lit(1.0), r["y1"] - r["y0"])
    rows = blocks.where(F.trim("rendered") != "").select(*page, "id", "r", chars.alias("source_chars"), (F.col("grouped") | F.col("direct_math") | F.col("with_formulas")).alias("__out"), "font", "leading", "units", "discount")
    rows = rows.withColumn("__n", F.lead(F.struct("r", "id")).over(w)).where(n.isNotNull() & ~F.col("__out") & (F.col("source_chars") >= GLUED_CHARS))
    b = n["r"]
    overlap = F.greatest(F.lit(0.0), F.least(r["x1"], b["x1"]) - F.greatest(r["x0"], b["x0"])) / F.greatest(F.lit(1.0), F.least(r["x1"] - r["x0"], b["x1"] - b["x0"]))
    gap, allowed = b["y0"] - r["y1"], b["y0"] - r["y0"] - COLLISION_GAP
    set_height = G.required_lines(r, F.col("units"), F.col("font")) * G.line_step(F.col("font"), F.col("leading")) * F.col("discount")
    hit = (F.col("source_chars") / height >= GLUED_RATIO) & (overlap >= GLUED_OVERLAP) & (gap >= 0) & (gap <= GLUED_GAP) & (allowed > 0) & (set_height > allowed * GLUED_OVERFLOW)
    return rows.where(hit).select(
        *page, "id", n["id"].alias("next_id"), "source_chars", (F.col("source_chars") / height).alias("char_height_ratio"), overlap.alias("width_overlap_ratio"), gap.alias("source_gap"), set_height.alias("estimated_height"),
        allowed.alias("allowed_height"), (set_height / allowed).alias("overflow_ratio"),
    )
