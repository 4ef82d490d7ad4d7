"""The multi-factor confidence as column expressions.

``weights`` and ``thresholds`` may be the dataclasses of swathe.config or any
object with the same attributes holding columns, which is how many weight sets
are scored in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathe.config import Thresholds, Weights
from swathe.functions.numbers import as_col, clip, round_even
from swathe.lexicon import SENSOR_FAMILIES

SIGNALS = [
    "visual_change", "semantic_change", "image_quality", "cloud_score", "shadow_score",
    "registration_confidence", "sensor_compatibility", "seasonal_compatibility",
    "spectral_evidence", "spatial_consistency",
]


def sensor_compatibility(sensor_a, gsd_a, sensor_b, gsd_b) -> Column:
    """70 % ground-resolution ratio, 30 % name match (same, same family, other)."""
    gsd_a = F.coalesce(F.nullif(gsd_a, F.lit(0.0)), F.lit(10.0))
    gsd_b = F.coalesce(F.nullif(gsd_b, F.lit(0.0)), F.lit(10.0))
    name = lambda s: F.lower(F.trim(F.coalesce(F.nullif(s, F.lit("")), F.lit("optical"))))
    a, b = name(sensor_a), name(sensor_b)
    family = F.lit(False)
    for word in SENSOR_FAMILIES:
        family = family | (a.contains(word) & b.contains(word))
    match = F.when(a == b, 1.0).when(family, 0.9).otherwise(0.7)
    return clip(F.least(gsd_a, gsd_b) / F.greatest(gsd_a, gsd_b) * 0.7 + match * 0.3, 0.1, 1.0)


def seasonal_compatibility(date_a: Column, date_b: Column) -> Column:
    """Cosine of the cyclic day-of-year gap: 1 on anniversaries, .1 half a year apart."""
    gap = F.abs(F.dayofyear(date_a) - F.dayofyear(date_b))
    gap = F.when(gap > 182, F.lit(365) - gap).otherwise(gap)
    score = (F.lit(1.0) + F.cos(F.pi() * (gap / 182.5))) * 0.5 * 0.9 + 0.1
    return F.coalesce(clip(score, 0.1, 1.0), F.lit(0.75))


def is_seasonal_vegetation(d_urban: Column, d_veg: Column, d_water: Column) -> Column:
    return (F.abs(d_veg) >= 6.0) & (F.abs(d_urban) < 2.0) & (F.abs(d_water) < 2.0)


def spectral_evidence(d_urban: Column, d_veg: Column, d_water: Column) -> Column:
    score = (
        F.when(is_seasonal_vegetation(d_urban, d_veg, d_water), 0.20)
        .when(F.abs(d_urban) >= 3.0, F.least(F.lit(0.98), F.abs(d_urban) * 0.05 + 0.60))
        .when(F.abs(d_water) >= 4.0, F.least(F.lit(0.95), F.abs(d_water) * 0.04 + 0.55))
        .when(d_veg <= -4.0, F.least(F.lit(0.90), F.abs(d_veg) * 0.04 + 0.50))
        .otherwise(0.50)
    )
    return clip(score, 0.05, 0.99)


def weight_total(w) -> Column:
    total = (as_col(w.visual) + w.semantic + w.spectral + w.spatial + w.quality
             + w.registration + w.sensor + w.seasonal)
    return F.coalesce(F.nullif(total, F.lit(0.0)), F.lit(1.0))


def weighted_mean(w) -> Column:
    weighted = (
        F.col("visual_change") * w.visual + F.col("semantic_change") * w.semantic
        + F.col("spectral_evidence") * w.spectral + F.col("spatial_consistency") * w.spatial
        + F.col("image_quality") * w.quality + F.col("registration_confidence") * w.registration
        + F.col("sensor_compatibility") * w.sensor + F.col("seasonal_compatibility") * w.seasonal
    )
    return weighted / weight_total(w)


def penalties(w) -> dict[str, Column]:
    """Each deduction, NULL where it does not apply.

    The season-timing and sensor deductions are rounded before they are summed;
    the others enter the sum as they are.
    """
    cloud, shadow = F.col("cloud_score"), F.col("shadow_score")
    registration = F.col("registration_confidence")
    seasonal, sensor = F.col("seasonal_compatibility"), F.col("sensor_compatibility")
    seasonal_flag = F.col("is_seasonal_vegetation")
    return {
        "cloud_penalty": F.when(
            cloud > 0.05, F.least(F.lit(0.60), F.pow(cloud, 1.3) * w.cloud_multiplier)),
        "shadow_penalty": F.when(
            shadow > 0.08, F.least(F.lit(0.35), F.pow(shadow, 1.2) * w.shadow_multiplier)),
        "misalignment_penalty": F.when(
            registration < 0.70,
            F.least(F.lit(0.50), (F.lit(0.70) - registration) * 1.5 * w.misalignment_multiplier)),
        "seasonal_vegetation_penalty": F.when(
            seasonal_flag, F.least(F.lit(0.45), as_col(w.seasonal_veg_multiplier) * 0.30)),
        "seasonal_timing_penalty": F.when(
            ~seasonal_flag & (seasonal < 0.40), round_even((F.lit(0.40) - seasonal) * 0.35, 4)),
        "sensor_mismatch_penalty": F.when(
            sensor < 0.60, round_even((F.lit(0.60) - sensor) * 0.30, 4)),
    }


PENALTIES = ["cloud_penalty", "shadow_penalty", "misalignment_penalty",
             "seasonal_vegetation_penalty", "seasonal_timing_penalty", "sensor_mismatch_penalty"]


def hard_suppression(t) -> Column:
    return (
        (F.col("cloud_score") >= t.cloud_limit)
        | (F.col("registration_confidence") <= t.registration_limit)
        | (F.col("is_seasonal_vegetation") & (F.col("spectral_evidence") <= t.seasonal_veg_limit))
        | (F.col("shadow_score") >= t.shadow_limit)
    )


def suppression_reasons(t) -> Column:
    cloud, shadow = F.col("cloud_score"), F.col("shadow_score")
    registration, sensor = F.col("registration_confidence"), F.col("sensor_compatibility")
    seasonal = F.col("is_seasonal_vegetation")
    pct = lambda text, c: F.format_string(text, c * 100.0)
    notes = [
        F.when(cloud >= t.cloud_limit, pct("high cloud coverage (%.1f%%)", cloud))
        .when(cloud >= 0.12, pct("moderate cloud/haze interference (%.1f%%)", cloud)),
        F.when(registration <= t.registration_limit,
               F.format_string("poor image alignment (correlation: %.2f)", registration))
        .when(registration < 0.65,
              F.format_string("sub-optimal image co-registration (%.2f)", registration)),
        F.when(seasonal & (F.col("spectral_evidence") <= t.seasonal_veg_limit),
               F.lit("seasonal vegetation variation (phenological shift without structural change)"))
        .when(seasonal, F.lit("vegetation index fluctuations detected across seasons")),
        F.when(shadow >= t.shadow_limit, pct("excessive shadow occlusion (%.1f%%)", shadow))
        .when(shadow >= 0.15, pct("illumination and cast shadow disparity (%.1f%%)", shadow)),
        F.when(sensor < 0.45,
               F.format_string("sensor mismatch (resolution/band disparity score: %.2f)", sensor)),
        F.when(F.col("image_quality") < 0.30,
               F.format_string("poor image quality or data fidelity (%.2f)", F.col("image_quality"))),
    ]
    found = F.array_compact(F.array(*notes))
    low_only = (F.size(found) == 0) & (F.col("confidence") < t.low)
    return F.when(
        low_only, F.array(F.lit("insufficient physical and semantic change evidence"))
    ).otherwise(found)


def positive_factors() -> Column:
    c = F.col
    return F.array_compact(F.array(
        F.when(c("registration_confidence") >= 0.85, F.format_string(
            "high sub-pixel registration accuracy (%.0f%%)", c("registration_confidence") * 100.0)),
        F.when((c("cloud_score") < 0.05) & (c("image_quality") >= 0.75),
               F.lit("clear atmospheric conditions and optimal image fidelity")),
        F.when(c("spatial_consistency") >= 0.70,
               F.lit("spatially coherent, contiguous change cluster")),
        F.when(c("semantic_change") >= 0.65,
               F.lit("strong semantic transition confirmed by vision model")),
        F.when(c("spectral_evidence") >= 0.70,
               F.lit("verified physical material / built-up expansion")),
        F.when(c("sensor_compatibility") >= 0.90, F.lit("homogeneous sensor observation pair")),
        F.when(c("seasonal_compatibility") >= 0.85,
               F.lit("consistent seasonal acquisition window")),
    ))


def tier(confidence: Column, suppressed: Column, t) -> Column:
    return (
        F.when(suppressed | (confidence < t.low), "Suppressed")
        .when(confidence >= t.high, "High Confidence")
        .when(confidence >= t.medium, "Medium Confidence")
        .otherwise("Low Confidence")
    )


def evaluate_signals(df: DataFrame, weights=Weights(), thresholds=Thresholds()) -> DataFrame:
    """Score rows holding the ten signals, ``is_seasonal_vegetation`` and ``query_match``.

    Narrow: no shuffle, every step stays in generated code.
    """
    w, t = weights, thresholds
    df = df.withColumns({s: clip(F.col(s), 0.0, 1.0) for s in SIGNALS})
    df = df.withColumns({"weighted_score": weighted_mean(w), **penalties(w)})
    total = sum((F.coalesce(F.col(p), F.lit(0.0)) for p in PENALTIES), F.lit(0.0))
    df = df.withColumn("total_penalty", total)
    raw = F.col("weighted_score") - F.col("total_penalty")
    blended = F.when(F.col("query_match").isNull(), raw).otherwise(
        raw * 0.70 + F.col("query_match") * 0.30)
    df = df.withColumn("confidence", clip(blended, 0.04, 0.99))
    df = df.withColumn("is_suppressed", hard_suppression(t) | (F.col("confidence") < t.low))
    return df.withColumns({
        "final_confidence": round_even(F.col("confidence"), 3),
        "confidence_tier": tier(F.col("confidence"), F.col("is_suppressed"), t),
        "reasons": suppression_reasons(t),
        "positive_factors": positive_factors(),
    })


def factor_breakdown(weights=Weights(), thresholds=Thresholds()) -> Column:
    """map<signal, struct<raw_value, weight, contribution, status>> of an evaluated row."""
    w, t = weights, thresholds
    total = weight_total(w)
    grade = lambda *steps: _grade(steps)
    c = F.col
    rows = [
        ("visual_change", w.visual, None, grade((c("visual_change") > 0.40, "optimal"), "moderate")),
        ("semantic_change", w.semantic, None,
         grade((c("semantic_change") > 0.50, "optimal"), "moderate")),
        ("image_quality", w.quality, None,
         grade((c("image_quality") >= 0.75, "optimal"), (c("image_quality") >= 0.40, "caution"),
               "concerning")),
        ("cloud_score", w.cloud_multiplier, "cloud_penalty",
         grade((c("cloud_score") < 0.08, "optimal"), (c("cloud_score") < t.cloud_limit, "caution"),
               "suppressed")),
        ("shadow_score", w.shadow_multiplier, "shadow_penalty",
         grade((c("shadow_score") < 0.10, "optimal"),
               (c("shadow_score") < t.shadow_limit, "caution"), "suppressed")),
        ("registration_confidence", w.registration, None,
         grade((c("registration_confidence") >= 0.80, "optimal"),
               (c("registration_confidence") > t.registration_limit, "caution"), "suppressed")),
        ("sensor_compatibility", w.sensor, None,
         grade((c("sensor_compatibility") >= 0.80, "optimal"), "moderate")),
        ("seasonal_compatibility", w.seasonal, None,
         grade((c("seasonal_compatibility") >= 0.70, "optimal"),
               (c("seasonal_compatibility") >= 0.40, "moderate"), "caution")),
        ("spectral_evidence", w.spectral, None,
         grade((c("spectral_evidence") >= 0.60, "optimal"), "moderate")),
        ("spatial_consistency", w.spatial, None,
         grade((c("spatial_consistency") >= 0.65, "optimal"), "moderate")),
    ]
    entries = []
    for signal, weight, penalty, status in rows:
        # A penalty is rounded to 4 digits where it is recorded, then to 3 for display.
        gain = (round_even(F.coalesce(c(penalty), F.lit(0.0)), 4) if penalty
                else c(signal) * weight / total)
        entries += [F.lit(signal), F.struct(
            round_even(c(signal), 3).alias("raw_value"), as_col(weight).alias("weight"),
            round_even(gain, 3).alias("contribution"), status.alias("status"))]
    return F.create_map(*entries)


def _grade(steps) -> Column:
    *ranked, last = steps
    chain = F
    for condition, word in ranked:
        chain = chain.when(condition, word)
    return chain.otherwise(last)
