"""Confidence scoring (CHG-11..20, CHG-24) and its reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import query
from swathe.config import Thresholds, Weights
from swathe.functions import confidence as cf
from swathe.operators import change, listing


def _clip(name: str) -> str:
    return f"least(1.0, greatest(0.0, {name}))"


def evaluated_sql(w: Weights = Weights(), t: Thresholds = Thresholds(), source: str = "signals") -> str:
    """The scoring in SQL, built up in three selects."""
    return f"""
 select *, greatest(0.04, least(0.99, case when query_match is null then ws - pen else (ws - pen) * 0.7 + query_match * 0.3 end)) as confidence from (
 select *, coalesce(p_cloud, 0) + coalesce(p_shadow, 0) + coalesce(p_misalign, 0) + coalesce(p_veg, 0) + coalesce(p_timing, 0) + coalesce(p_sensor, 0) as pen from (
 select *, (visual_change * {w.visual} + semantic_change * {w.semantic} + spectral_evidence * {w.spectral} + spatial_consistency * {w.spatial}
   + image_quality * {w.quality} + registration_confidence * {w.registration} + sensor_compatibility * {w.sensor} + seasonal_compatibility * {w.seasonal})
   / (cast({w.visual} as double) + {w.semantic} + {w.spectral} + {w.spatial} + {w.quality} + {w.registration} + {w.sensor} + {w.seasonal}) as ws,
  case when cloud_score > 0.05 then least(0.6, pow(cloud_score, 1.3) * {w.cloud_multiplier}) end as p_cloud,
  case when shadow_score > 0.08 then least(0.35, pow(shadow_score, 1.2) * {w.shadow_multiplier}) end as p_shadow,
  case when registration_confidence < 0.7 then least(0.5, (0.7 - registration_confidence) * 1.5 * {w.misalignment_multiplier}) end as p_misalign,
  case when is_seasonal_vegetation then least(0.45, 0.3 * {w.seasonal_veg_multiplier}) end as p_veg,
  case when not is_seasonal_vegetation and seasonal_compatibility < 0.4 then round((0.4 - seasonal_compatibility) * 0.35, 6) end as p_timing,
  case when sensor_compatibility < 0.6 then round((0.6 - sensor_compatibility) * 0.3, 6) end as p_sensor
 from {source}) a) b"""


HARD = "(cloud_score >= 0.25 or registration_confidence <= 0.4 or (is_seasonal_vegetation and spectral_evidence <= 0.6) or shadow_score >= 0.4)"
TIER = f"""case when {HARD} or confidence < 0.25 then 'Suppressed' when confidence >= 0.7 then 'High Confidence'
 when confidence >= 0.45 then 'Medium Confidence' else 'Low Confidence' end"""


def r8(name):
    return F.round(F.col(name), 8).alias(name)


@query("CHG-11_sensor_compatibility", "", """
select l_orderkey, l_linenumber, round(least(1.0, greatest(0.1, least(g1, g2) / greatest(g1, g2) * 0.7 + 0.3 * case
  when lower(s1) = lower(s2) then 1.0 when (s1 ilike '%sentinel%' and s2 ilike '%sentinel%') or (s1 ilike '%landsat%' and s2 ilike '%landsat%') then 0.9 else 0.7 end)), 8) as compat
from (select l_orderkey, l_linenumber,
 cast(case l_partkey % 4 when 0 then 10 when 1 then 30 when 2 then 15 else 10 end as double) as g1, cast(case l_suppkey % 3 when 0 then 10 when 1 then 60 else 30 end as double) as g2,
 case l_partkey % 3 when 0 then 'Sentinel-2A' when 1 then 'LANDSAT-8' else 'SPOT' end as s1,
 case l_suppkey % 4 when 0 then 'sentinel-2a' when 1 then 'Landsat-9' when 2 then 'Sentinel-2B' else 'spot' end as s2 from lineitem) x""")
def _(t):
    word = lambda n, *names: F.element_at(F.array(*[F.lit(x) for x in names]), n.cast("int") + 1)
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(cf.sensor_compatibility(
        word(p % 3, "Sentinel-2A", "LANDSAT-8", "SPOT"),
        F.when(p % 4 == 3, F.lit(0.0)).otherwise(word(p % 4, 10.0, 30.0, 15.0, 0.0)),
        word(s % 4, "sentinel-2a", "Landsat-9", "Sentinel-2B", "spot"), word(s % 3, 10.0, 60.0, 30.0)), 8).alias("compat"))


@query("CHG-12_seasonal_compatibility", "", """
select l_orderkey, l_linenumber, round(case when gap is null then 0.75 else least(1.0, greatest(0.1, 0.9 * 0.5 * (1 + cos(pi() * gap / 182.5)) + 0.1)) end, 6) as compat from (
 select l_orderkey, l_linenumber, case when d > 182 then 365 - d else d end as gap from (
  select l_orderkey, l_linenumber, abs(dayofyear(l_shipdate) - dayofyear(o_orderdate)) as d
  from lineitem left join (select * from orders where o_custkey % 10 <> 0) o on o_orderkey = l_orderkey) a) b""")
def _(t):
    o = t.orders.where("o_custkey % 10 <> 0").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return t.lineitem.join(o, "l_orderkey", "left").select("l_orderkey", "l_linenumber", F.round(
        cf.seasonal_compatibility(F.col("l_shipdate"), F.col("o_orderdate")), 6).alias("compat"))


@query("CHG-13_spectral_evidence", "pair_facts", """
select pair_id, seasonal, round(least(0.99, greatest(0.05, case when seasonal then 0.2 when abs(u) >= 3 then least(0.98, 0.6 + 0.05 * abs(u))
  when abs(w) >= 4 then least(0.95, 0.55 + 0.04 * abs(w)) when v <= -4 then least(0.9, 0.5 + 0.04 * abs(v)) else 0.5 end)), 8) as evidence from (
 select *, abs(v) >= 6 and abs(u) < 2 and abs(w) < 2 as seasonal from (select pair_id, after_urban_pct - before_urban_pct as u,
  after_veg_pct - before_veg_pct as v, after_water_pct - before_water_pct as w from pair_facts) a) b""")
def _(t):
    d = [F.col(f"after_{c}_pct") - F.col(f"before_{c}_pct") for c in ("urban", "veg", "water")]
    return t.pair_facts.select("pair_id", cf.is_seasonal_vegetation(*d).alias("seasonal"),
                               F.round(cf.spectral_evidence(*d), 8).alias("evidence"))


@query("CHG-15_evaluate_signals", "signals", f"""
select case_id, round(ws, 8) as weighted_score, round(pen, 8) as total_penalty, round(confidence, 8) as confidence from ({evaluated_sql()}) e
where (is_seasonal_vegetation or seasonal_compatibility >= 0.4) and sensor_compatibility >= 0.6
union all
select case_id, round(ws, 8), null, null from ({evaluated_sql()}) e
where not ((is_seasonal_vegetation or seasonal_compatibility >= 0.4) and sensor_compatibility >= 0.6)""")
def _(t):
    """The two deductions that are rounded half-to-even at 4 digits are checked in CHG-15_rounded."""
    e = cf.evaluate_signals(t.signals)
    exact = F.col("seasonal_timing_penalty").isNull() & F.col("sensor_mismatch_penalty").isNull()
    return e.select("case_id", r8("weighted_score"), *[
        F.when(exact, F.round(F.col(c), 8)).alias(c) for c in ("total_penalty", "confidence")])


@query("CHG-15_rounded_penalties", "signals", """
select case_id, case when not is_seasonal_vegetation and seasonal_compatibility < 0.4 then abs(p1 - (0.4 - seasonal_compatibility) * 0.35) <= 0.00005000001 end as timing_ok,
 case when sensor_compatibility < 0.6 then abs(p2 - (0.6 - sensor_compatibility) * 0.3) <= 0.00005000001 end as sensor_ok
from (select *, round_even((0.4 - seasonal_compatibility) * 0.35, 4) as p1, round_even((0.6 - sensor_compatibility) * 0.3, 4) as p2 from signals) s""")
def _(t):
    e = cf.evaluate_signals(t.signals)
    close = lambda c, exact: F.abs(F.col(c) - exact) <= 0.00005000001
    return e.select(
        "case_id",
        close("seasonal_timing_penalty", (F.lit(0.4) - F.col("seasonal_compatibility")) * 0.35).alias("timing_ok"),
        close("sensor_mismatch_penalty", (F.lit(0.6) - F.col("sensor_compatibility")) * 0.3).alias("sensor_ok"))


@query("CHG-16_suppression", "signals", f"""
select case_id, {HARD} as hard,
 cast((cloud_score >= 0.12)::int + (registration_confidence < 0.65)::int + is_seasonal_vegetation::int + (shadow_score >= 0.15)::int
  + (sensor_compatibility < 0.45)::int + (image_quality < 0.3)::int as bigint) as given_reasons,
 case when cloud_score >= 0.25 then 'high cloud' when cloud_score >= 0.12 then 'moderate cloud' when registration_confidence <= 0.4 then 'poor image'
  when registration_confidence < 0.65 then 'sub-optimal' when is_seasonal_vegetation and spectral_evidence <= 0.6 then 'seasonal v'
  when is_seasonal_vegetation then 'vegetation' when shadow_score >= 0.4 then 'excessive' when shadow_score >= 0.15 then 'illuminati'
  when sensor_compatibility < 0.45 then 'sensor mis' when image_quality < 0.3 then 'poor image' end as first_reason from signals""")
def _(t):
    e = cf.evaluate_signals(t.signals)
    other = F.col("reasons")[0].startswith("insufficient")
    first = F.get("reasons", F.lit(0))
    head = (F.when(first.startswith("high cloud"), "high cloud").when(first.startswith("moderate cloud"), "moderate cloud")
            .when(first.startswith("sub-optimal"), "sub-optimal").when(first.startswith("vegetation"), "vegetation")
            .when(first.startswith("excessive"), "excessive").otherwise(F.substring(first, 1, 10)))
    lone = first.startswith("insufficient")
    return e.select(
        "case_id", cf.hard_suppression(Thresholds()).alias("hard"),
        F.when(lone, 0).otherwise(F.size("reasons")).cast("long").alias("given_reasons"),
        F.when(~lone, head).alias("first_reason"))


@query("CHG-17_positive_factors", "signals", """
select case_id, cast((registration_confidence >= 0.85)::int + (cloud_score < 0.05 and image_quality >= 0.75)::int + (spatial_consistency >= 0.7)::int
 + (semantic_change >= 0.65)::int + (spectral_evidence >= 0.7)::int + (sensor_compatibility >= 0.9)::int + (seasonal_compatibility >= 0.85)::int as bigint) as n,
 coalesce(case when seasonal_compatibility >= 0.85 then 'consistent' when sensor_compatibility >= 0.9 then 'homogeneou' when spectral_evidence >= 0.7 then 'verified p'
  when semantic_change >= 0.65 then 'strong sem' when spatial_consistency >= 0.7 then 'spatially ' when cloud_score < 0.05 and image_quality >= 0.75 then 'clear atmo'
  when registration_confidence >= 0.85 then 'high sub-p' end, '') as last_note from signals""")
def _(t):
    e = cf.evaluate_signals(t.signals)
    return e.select("case_id", F.size("positive_factors").cast("long").alias("n"), F.coalesce(
        F.substring(F.try_element_at("positive_factors", F.lit(-1)), 1, 10), F.lit("")).alias("last_note"))


@query("CHG-18_tier", "signals", f"""
select confidence_tier, count(*) as n, count(distinct case_id) as cases from (select case_id, {TIER} as confidence_tier from ({evaluated_sql()}) e) x group by 1""")
def _(t):
    return cf.evaluate_signals(t.signals).groupBy("confidence_tier").agg(
        F.count("*").alias("n"), F.count_distinct("case_id").alias("cases"))


@query("CHG-19_factor_breakdown", "signals", """
select case_id, factor, weight, status, round(gain, 2) as gain from (
 select case_id, 'visual_change' as factor, 0.25::double as weight, case when visual_change > 0.4 then 'optimal' else 'moderate' end as status, visual_change * 0.25::double as gain from signals
 union all select case_id, 'image_quality', 0.08, case when image_quality >= 0.75 then 'optimal' when image_quality >= 0.4 then 'caution' else 'concerning' end, image_quality * 0.08::double from signals
 union all select case_id, 'cloud_score', 1.2, case when cloud_score < 0.08 then 'optimal' when cloud_score < 0.25 then 'caution' else 'suppressed' end, null from signals
 union all select case_id, 'registration_confidence', 0.08, case when registration_confidence >= 0.8 then 'optimal' when registration_confidence > 0.4 then 'caution' else 'suppressed' end, null from signals
 union all select case_id, 'seasonal_compatibility', 0.02, case when seasonal_compatibility >= 0.7 then 'optimal' when seasonal_compatibility >= 0.4 then 'moderate' else 'caution' end, null from signals
 union all select case_id, 'spatial_consistency', 0.15, case when spatial_consistency >= 0.65 then 'optimal' else 'moderate' end, null from signals) x
where gain is null or abs(gain * 100 - floor(gain * 100) - 0.5) > 0.06""")
def _(t):
    """Contributions are compared to 2 digits, away from rounding borders."""
    e = cf.evaluate_signals(t.signals).select(
        "case_id", F.explode(cf.factor_breakdown()).alias("factor", "d"), "visual_change", "image_quality")
    exact = F.when(F.col("factor") == "visual_change", F.col("visual_change") * 0.25).when(
        F.col("factor") == "image_quality", F.col("image_quality") * 0.08)
    keep = exact.isNull() | (F.abs(exact * 100 - F.floor(exact * 100) - 0.5) > 0.06)
    shown = ["visual_change", "image_quality", "cloud_score", "registration_confidence",
             "seasonal_compatibility", "spatial_consistency"]
    return e.where(F.col("factor").isin(shown) & keep).select(
        "case_id", "factor", F.col("d.weight").alias("weight"), F.col("d.status").alias("status"),
        F.when(exact.isNotNull(), F.round("d.contribution", 2)).alias("gain"))


CONFIGS = [("default", Weights(), Thresholds()),
           ("visual_only", Weights(visual=1.0, semantic=0.0, spectral=0.0, spatial=0.0, quality=0.0,
                                   registration=0.0, sensor=0.0, seasonal=0.0), Thresholds()),
           ("mild", Weights(cloud_multiplier=0.5, shadow_multiplier=0.1, misalignment_multiplier=0.5,
                            seasonal_veg_multiplier=0.5), Thresholds())]


@query("CHG-20_evaluate_with_override", "signals", "with " + ", ".join(
    f"c{i} as ({evaluated_sql(w, t)})" for i, (_, w, t) in enumerate(CONFIGS)) + " " + " union all ".join(
    f"select '{name}' as config, case_id, {TIER} as confidence_tier, round(ws, 8) as weighted_score from c{i}"
    for i, (name, _, _) in enumerate(CONFIGS)))
def _(t):
    swept = change.evaluate_with_configs(t.signals, CONFIGS)
    return swept.select("config", "case_id", "confidence_tier", r8("weighted_score"))


@query("CHG-24_event_metadata_backfill", "events_table", """
select event_id, coalesce(confidence_tier, case when final_confidence > 0.5 then 'Medium Confidence' else 'Low Confidence' end) as confidence_tier,
 case when l % 2 = 0 then 'stored' else 'from breakdown' end as reason from (select *, event_id % 8 as l from events_table) x""")
def _(t):
    spare = F.when(F.col("final_confidence") > 0.5, "Medium Confidence").otherwise("Low Confidence")
    e = t.events_table.withColumns({
        "reasons": F.when(F.col("event_id") % 8 % 2 == 0, F.array(F.lit("stored"))),
        "positive_factors": F.lit(None).cast("array<string>"),
        "breakdown": F.struct(
            spare.alias("confidence_tier"), F.array(F.lit("from breakdown")).alias("reasons"),
            F.array(F.lit("x")).alias("positive_factors"))})
    return change.backfill_event_metadata(e).select(
        "event_id", "confidence_tier", F.col("reasons")[0].alias("reason"))


@query("AGG-07_tier_counts", "events_table", """
select count(*) as "all",
 count(*) filter (confidence_tier = 'High Confidence' or (not is_suppressed and final_confidence >= 0.7)) as high,
 count(*) filter (confidence_tier = 'Medium Confidence' or (not is_suppressed and final_confidence >= 0.45 and final_confidence < 0.7)) as medium,
 count(*) filter (confidence_tier = 'Low Confidence' or (not is_suppressed and final_confidence < 0.45)) as low,
 count(*) filter (is_suppressed or confidence_tier = 'Suppressed') as suppressed from events_table""")
def _(t):
    return listing.tier_counts(t.events_table)


@query("AGG-08_model_eval_rates", "signals", f"""
select round(100.0 * count(*) filter (kind = 'false_alarm_x' and hidden) / count(*) filter (kind = 'false_alarm_x'), 6) as suppression_rate,
 round(100.0 * count(*) filter (kind = 'true_x' and not hidden) / count(*) filter (kind = 'true_x'), 6) as retention_rate,
 round(100.0 * count(*) filter (confidence_tier = 'Suppressed' and kind = 'false_alarm_x' or confidence_tier = 'High Confidence' and kind = 'true_x' or hidden = (kind = 'false_alarm_x')) / count(*), 6) as accuracy
from (select *, case when spatial_consistency < 0.5 then 'false_alarm_x' else 'true_x' end as kind, confidence_tier = 'Suppressed' as hidden
 from (select *, {TIER} as confidence_tier from ({evaluated_sql()}) e) f) g""")
def _(t):
    alarm = F.col("spatial_consistency") < 0.5
    cases = cf.evaluate_signals(t.signals).withColumns({
        "kind": F.when(alarm, "false_alarm_x").otherwise("true_x"),
        "expected_tier": F.when(alarm, "Suppressed").otherwise("High Confidence"),
        "expected_suppressed": alarm, "latency_ms": F.lit(1.0)})
    r = listing.model_eval_rates(cases)
    return r.select(*[F.round(F.col(c), 6).alias(c) for c in (
        "suppression_rate", "retention_rate", "accuracy")])
