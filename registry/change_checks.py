"""Change detection on pixels, land cover and queries (CHG-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import query
from registry.pairing_checks import _pairs
from registry.pixel_checks import GRAY
from registry.text_checks import any_of, squeeze, sub
from swathe import lexicon as lx
from swathe.functions import text as tx
from swathe.operators import change, landcover, pairing
from swathe.plans import change as flow

DIFF = """
d as (select a.tile_id as pair_id, a.y, a.x, abs(a.r - b.r) as dr, abs(a.g - b.g) as dg, abs(a.b - b.b) as db, b.r as r2, b.g as g2, b.b as b2 from images a join images b on b.tile_id = a.tile_id + 25 and a.y = b.y and a.x = b.x),
m as (select *, floor((9798 * dr + 19235 * dg + 3735 * db + 16384) / 32768) > 28 as changed from d)"""


def diff(t):
    return change.pixel_diff(pairing.pair_pixels(_pairs(t), t.images))


@query("CHG-01_pixel_diff", "images", f"with {DIFF} select pair_id, y, count(*) filter (changed) as changed, cast(sum(dr + 2 * dg + 3 * db) as bigint) as total from m group by 1, 2")
def _(t):
    return diff(t).groupBy("pair_id", "y").agg(
        F.sum(F.col("changed").cast("long")).alias("changed"),
        F.sum((F.col("dr") + F.col("dg") * 2 + F.col("db") * 3).cast("long")).alias("total"))


@query("CHG-02_change_area", "images tiles", f"with {DIFF}" + """
select pair_id, c as changed_pixels, n as total_pixels, round_even(c / n * 100.0::double, 2)::double as changed_pct, c * res * res as altered_area_m2, round_even(c * res * res / 10000, 2)::double as altered_area_ha
from (select pair_id, count(*) filter (changed) as c, count(*) as n from m group by 1) x join (select tile_id as pair_id, resolution_m as res from tiles) t using (pair_id)""")
def _(t):
    return change.change_area(diff(t), _pairs(t)).select(
        "pair_id", "changed_pixels", "total_pixels", "changed_pct", "altered_area_m2", "altered_area_ha")


@query("CHG-03_visual_score", "images", f"with {DIFF}" + """
select pair_id, round(least(1.0, greatest(0.05, rmse / 28)), 6) as visual_score, round(least(1.0, greatest(0.0, rmse / 28)), 6) as plain_score from (
 select pair_id, sqrt(avg((dr * dr + dg * dg + db * db) / 3.0::double)) as rmse from d group by 1) x""")
def _(t):
    plain = change.visual_score(diff(t), 0.0).withColumnRenamed("visual_score", "plain_score")
    return change.visual_score(diff(t)).join(plain, "pair_id").select(
        "pair_id", F.round("visual_score", 6).alias("visual_score"), F.round("plain_score", 6).alias("plain_score"))


@query("CHG-03_line_stats", "images", f"with {DIFF}" + """
select pair_id, count(*) as total_pixels, count(*) filter (changed) as changed_pixels, round(least(1.0, greatest(0.05, sqrt(avg((dr * dr + dg * dg + db * db) / 3.0::double)) / 28)), 6) as visual_score from m group by 1""")
def _(t):
    return change.line_stats(change.diff_lines(diff(t))).select(
        "pair_id", "total_pixels", "changed_pixels", F.round("visual_score", 6).alias("visual_score"))


SHIFTS = [(dx, dy) for dy in (-2, -1, 0, 1, 2) for dx in (-2, -1, 0, 1, 2)]


@query("CHG-04_register_shift", "images", "with " + f"""
a as (select tile_id as pair_id, y, x, cast({GRAY} as double) as v from images),
b as (select tile_id - 25 as pair_id, y, x, cast({GRAY} as double) as v from images),
s(dx, dy) as (values {', '.join(map(str, SHIFTS))}),
c as (select a.pair_id, dx, dy, corr(a.v, b.v) as r from a cross join s join b on b.pair_id = a.pair_id and b.y = a.y + dy and b.x = a.x + dx group by 1, 2, 3)
select pair_id, round(least(1.0, greatest(0.0, max(coalesce(r, 0)))), 6) as registration_quality from c where not isnan(r) group by 1""")
def _(t):
    shift = change.register_shift(pairing.pair_pixels(_pairs(t), t.images))
    return shift.select("pair_id", F.round("registration_quality", 6).alias("registration_quality"))


@query("CHG-05_landcover_delta", "images", """
with lc as (select tile_id, round(avg(r), 1) as water_pct, round(avg(g), 1) as veg_pct, round(avg(b), 1) as urban_pct from images where tile_id % 11 <> 3 group by 1)
select p.tile_id as pair_id, round(coalesce(b.water_pct, 0) - coalesce(a.water_pct, 0), 1) as d_water, round(coalesce(b.veg_pct, 0) - coalesce(a.veg_pct, 0), 1) as d_veg,
 round(coalesce(b.urban_pct, 100) - coalesce(a.urban_pct, 100), 1) as d_urban from (select distinct tile_id from images) p left join lc a on a.tile_id = p.tile_id left join lc b on b.tile_id = p.tile_id + 25""")
def _(t):
    """Band means stand in for land-cover shares, to have every kind of difference."""
    cover = t.images.where("tile_id % 11 <> 3").groupBy("tile_id").agg(
        F.round(F.avg("r"), 1).alias("water_pct"), F.round(F.avg("g"), 1).alias("veg_pct"), F.round(F.avg("b"), 1).alias("urban_pct"))
    return change.landcover_delta(_pairs(t), cover).select("pair_id", "d_water", "d_veg", "d_urban")


DELTAS = """f as (select *, round(after_urban_pct - before_urban_pct, 1) as d_urban, round(after_veg_pct - before_veg_pct, 1) as d_veg, round(after_water_pct - before_water_pct, 1) as d_water from {src})"""
BASE_TYPE = """case when d_urban >= 2 then 'new_construction' when d_urban <= -2 then 'built_up_reduction' when d_veg <= -2 then 'vegetation_clearance' when d_veg >= 2 then 'vegetation_growth'
 when abs(d_water) >= 2 then 'water_change' else 'structural_change' end"""


def facts(t):
    d = lambda c: F.round(F.col(f"after_{c}_pct") - F.col(f"before_{c}_pct"), 1).alias(f"d_{c}")
    return t.pair_facts.select("*", d("urban"), d("veg"), d("water"))


@query("CHG-06_base_change_type", "pair_facts", f"with {DELTAS.format(src='pair_facts')} select pair_id, {BASE_TYPE} as change_type from f")
def _(t):
    return facts(t).select("pair_id", change.base_change_type(
        F.col("d_urban"), F.col("d_veg"), F.col("d_water")).alias("change_type"))


SITES = f"""
k as (select *, string_split({squeeze(sub('lower(site_name)', '[_./-]'))}, ' ') as path_tokens from f),
g as (select *, {any_of('path_tokens', lx.SITE_WORDS['solar'])} as solar_site, {any_of('path_tokens', lx.SITE_WORDS['airport'])} as airport_site, {any_of('path_tokens', lx.SITE_WORDS['road'])} as road_site,
 {any_of('path_tokens', lx.SITE_WORDS['water'])} or before_water_pct >= 10 or after_water_pct >= 10 as water_site from k)"""


@query("CHG-08_site_flags", "pair_facts", f"with {DELTAS.format(src='pair_facts')}, {SITES} select pair_id, solar_site, airport_site, road_site, water_site from g")
def _(t):
    flags = tx.site_flags(tx.path_tokens(F.col("site_name")), F.col("before_water_pct"), F.col("after_water_pct"))
    return t.pair_facts.select("pair_id", *[c.alias(n) for n, c in flags.items()])


def _rule_sql() -> str:
    """The rules as a chain of selects, each reading the score and type of the one before."""
    up = lambda base_, bonus: f"least(0.99::double, greatest(m, {base_}::double) + {bonus}::double)"
    down = lambda floor, by: f"greatest({floor}::double, m - {by}::double)"
    steps = [
        (["asks_solar and (solar_site or (d_urban >= 10 and after_veg_pct < 20 and not water_site))", up(.88, .10), "'solar_park_development'"],
         ["asks_solar", "0.05", "kind"], ["asks_aviation and airport_site", up(.88, .10), "'airport_expansion'"], ["asks_aviation", "0.05", "kind"]),
        (["asks_road and not asks_aviation and road_site and d_urban >= 1", up(.90, .08), "'road_infrastructure_expansion'"],
         ["asks_road and not asks_aviation and (solar_site or water_site)", "0.05", "kind"],
         ["asks_road and not asks_aviation and d_urban >= 2", "least(0.85::double, greatest(m, 0.65::double))", "'road_infrastructure_expansion'"],
         ["asks_road and not asks_aviation", down(.08, .35), "kind"]),
        (["asks_water and not asks_construction and (water_site or mw >= 1)", up(.90, .08), "case when d_water >= 1 then 'water_area_increase' when d_water <= -1 then 'water_area_decrease' else 'water_surface_stability' end"],
         ["asks_water and not asks_construction", "0.02", "kind"], ["asks_water and mw >= 1 and d_urban >= 1", "0.98", "'waterfront_construction'"],
         ["asks_water and asks_construction and mw < 1", down(.05, .40), "kind"]),
        (["plain and water_site", "0.05", "kind"], ["plain and solar_site", "0.35", "kind"], ["plain and d_urban >= 2", up(.85, .10), "'new_construction'"], ["plain and d_urban <= -1", down(.10, .20), "kind"]),
        (["asks_veg_loss and d_veg <= -2", up(.85, .12), "'vegetation_loss'"], ["asks_veg_loss", down(.08, .35), "kind"]),
        (["asks_appearance and (d_urban >= 2 or abs(d_water) >= 1 or visual_score >= 0.4)", up(.88, .10), "kind"],),
        (["asks_suppression and registration_quality >= 0.55 and max_cloud < 15 and (d_urban >= 2 or abs(d_water) >= 2 or visual_score >= 0.45)", up(.90, .08), "kind"],
         ["asks_suppression and registration_quality >= 0.55 and max_cloud < 15", down(.15, .25), "kind"], ["asks_suppression", down(.10, .30), "kind"]),
        (["after_year < asks_since", down(.02, .50), "kind"],),
        (["placed and here", "least(0.99::double, m + 0.15::double)", "kind"], ["placed", down(.02, .50), "kind"]),
    ]
    sql, before = "", "r0"
    for i, cases in enumerate(steps, start=1):
        score = " ".join(f"when {c} then {s}" for c, s, _ in cases)
        kind = " ".join(f"when {c} then {k}" for c, _, k in cases)
        sql += f",\nr{i} as (select * exclude (m, kind), case {score} else m end as m, case {kind} else kind end as kind from {before})"
        before = f"r{i}"
    return sql


ASKS = {k: lx.CHANGE_QUERY_WORDS[k] for k in ("construction", "veg_loss", "solar", "aviation", "road")}


@query("CHG-09_query_match", "pair_facts query_log", f"""with j as (select p.*, lower(q.raw_query) as low, string_split({squeeze(sub('lower(q.raw_query)', '''[,\\-_."']'''))}, ' ') as words, string_split({squeeze(sub('lower(q.raw_query)', r'[&/,.-]'))}, ' ') as iwords from pair_facts p join query_log q on q.query_id = p.pair_id),
{DELTAS.format(src='j')}, {SITES},
h as (select *, {', '.join(f"{any_of('words', v)} as asks_{k}" for k, v in ASKS.items())},
 {any_of('words', lx.CHANGE_QUERY_WORDS['water'])} or {any_of('iwords', lx.INTENT_WORDS['water'])} or regexp_matches(low, '{'|'.join(lx.INTENT_PHRASES['water'])}') as asks_water,
 contains(low, 'first appeared') or (contains(low, 'when') and contains(low, 'appear')) or contains(low, 'timeline') as asks_appearance,
 {any_of('words', lx.CHANGE_QUERY_WORDS['suppression'])} or regexp_matches(low, 'high.confidence|seasonal variation') as asks_suppression,
 case when regexp_matches(low, '(after|post|since) 2023') then 2023 when regexp_matches(low, '(after|post|since) 2020') then 2020 end as asks_since,
 {any_of('words', lx.PLACE_WORDS)} as placed, len(list_filter(list_intersect(words, path_tokens), lambda w: list_contains({lx.PLACE_WORDS}, w))) > 0 as here,
 greatest(before_water_pct, after_water_pct) as mw, year(after_date) as after_year from g),
r0 as (select *, asks_construction and not (asks_solar or asks_aviation or asks_water or asks_road) as plain, first_match as m, {BASE_TYPE} as kind from h){_rule_sql()}
select pair_id, round(m, 8) as query_match, kind as change_type from r9""")
def _(t):
    log = t.query_log.select(F.col("query_id").alias("pair_id"), *[
        c.alias(n) for n, c in tx.change_query_flags(F.col("raw_query")).items()])
    df = facts(t).join(log, "pair_id").withColumn("path_tokens", tx.path_tokens(F.col("site_name")))
    df = df.withColumns({
        **tx.site_flags(F.col("path_tokens"), F.col("before_water_pct"), F.col("after_water_pct")),
        "query_match": F.col("first_match"), "notes": F.array().cast("array<string>"),
        "altered_area_m2": F.lit(1.0), "after_year": F.year("after_date"), "before_date": F.col("after_date"),
        "change_type": change.base_change_type(F.col("d_urban"), F.col("d_veg"), F.col("d_water"))})
    return change.query_match(df).select("pair_id", F.round("query_match", 8).alias("query_match"), "change_type")


@query("CHG-10_spatial_consistency")
def _(t):
    mask = diff(t).where("changed")
    return change.spatial_consistency(mask, _pairs(t)).select(
        "pair_id", F.round("spatial_consistency", 6).alias("spatial_consistency"))


@query("CHG-10_mask_runs", "images", f"with {DIFF}" + """
select pair_id, y, min(x) as x0, max(x) as x1 from (select pair_id, y, x, x - row_number() over (partition by pair_id, y order by x) as island from m where changed) q group by pair_id, y, island""")
def _(t):
    return change.mask_runs(diff(t).where("changed"))


@query("CHG-10_component_area", "images", f"with {DIFF} select pair_id, count(*) as changed from m where changed group by 1")
def _(t):
    """Component areas add up to the changed pixels of each pair."""
    return change.change_components(diff(t).where("changed")).groupBy("pair_id").agg(F.sum("area").alias("changed"))


@query("CHG-14_pair_signals", "tiles images", f"with {DIFF}" + """
, sh as (select pair_id, avg(cast(floor((9798 * r2 + 19235 * g2 + 3735 * b2 + 16384) / 32768) < 35 as int)) as shadow_score from d group by 1)
select pair_id, least(coalesce(nullif(a.quality_score, 0), 0.8), coalesce(nullif(b.quality_score, 0), 0.8)) as image_quality,
 round(greatest(a.cloud_cover_pct, b.cloud_cover_pct) / 100, 8) as cloud_score, round(shadow_score, 8) as shadow_score
from sh join tiles a on a.tile_id = pair_id join tiles b on b.tile_id = pair_id + 25""")
def _(t):
    pairs = flow.pair_attributes(_pairs(t).drop("resolution_m"), t.tiles, t.scenes)
    df = pairs.join(change.pair_pixel_stats(diff(t)), "pair_id").withColumns({
        "registration_quality": F.lit(1.0), "semantic_score": F.lit(0.5),
        **{c: F.lit(0.0) for c in ("d_urban", "d_veg", "d_water")}})
    return change.pair_signals(df).select(
        "pair_id", "image_quality", F.round("cloud_score", 8).alias("cloud_score"), F.round("shadow_score", 8).alias("shadow_score"))


@query("CHG-21_change_events")
def _(t):
    pairs = flow.pair_attributes(pairing.matched_pairs(t.tiles.where("is_valid")), t.tiles, t.scenes)
    scored = flow.score_pairs(flow.pair_evidence(pairs, t.images, t.vectors))
    return change.change_events(scored).select(
        "event_id", "before_tile", "after_tile", "change_type", F.round("final_confidence", 3).alias("final_confidence"),
        "confidence_tier", "is_suppressed", "evidence.explanation")


@query("CHG-22_rank_events", "events_table", """
select event_id, row_number() over (order by fits desc, round(case when fits then 0.7 * qm + 0.3 * final_confidence else final_confidence end, 9) desc, event_id) as place from (select *, round(query_match, 3) as qm, coalesce(round(query_match, 3) >= 0.25, false) as fits from events_table) x
order by fits desc, round(case when fits then 0.7 * qm + 0.3 * final_confidence else final_confidence end, 9) desc, event_id limit 400""")
def _(t):
    from pyspark.sql import Window
    ranked = change.rank_events(t.events_table, 400, True)
    fits = F.round("query_match", 3) >= 0.25
    key = F.round(F.when(fits, F.round("query_match", 3) * 0.7 + F.col("final_confidence") * 0.3).otherwise(F.col("final_confidence")), 9)
    order = Window.orderBy(fits.desc(), key.desc(), "event_id")
    return ranked.select("event_id", F.row_number().over(order).cast("long").alias("place"))


@query("CHG-22_rank_events_plain", "events_table", "select event_id, final_confidence from events_table order by final_confidence desc, event_id limit 300")
def _(t):
    return change.rank_events(t.events_table, 300, False).select("event_id", "final_confidence")


@query("CHG-23_analyze_change")
def _(t):
    events = flow.analyze_change(
        t.tiles, t.scenes, t.images, t.vectors,
        query="new construction near water bodies after 2019", start="2018-01-01", end="2026-01-01", limit=60)
    return events.select("event_id", "before_tile", "after_tile", "change_type", "final_confidence", "confidence_tier",
                         F.round("query_match", 6).alias("query_match"), "evidence.explanation")
