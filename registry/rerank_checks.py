"""Hybrid rerank and the search flow (SCR-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import query
from registry.text_checks import any_of, intent_flags, q, squeeze, sub
from swathe import lexicon as lx
from swathe.functions import text as tx
from swathe.operators import landcover, rerank
from swathe.plans import search
from swathe.session import cut_lineage


def name_says(*words: str) -> str:
    return "(" + " or ".join(f"contains(name, {q(w)})" for w in words) + ")"


# Every query of the log meets one invented tile: land cover from its number, a scene name, a cosine.
CANDIDATES = """
cand as (select i.*, cast((query_id * 7) % 300 as double) / 10 as w, cast((query_id * 13) % 600 as double) / 10 as v, cast((query_id * 29) % 1001 as double) / 10 as u,
 cast((query_id * 17) % 101 as double) / 1000 - 0.06 as score, s.filename, lower(s.filename) as name, query_id % 20 as tile_id from intents i join scenes s on s.scene_id = query_id % 20)"""
BUILT = "case when {hit} then least(0.98, 0.88 + least(0.06, (u - {f}) / 500) + {b}) else 0.88 + least(0.06, (u - {f}) / 500) end"
REMOTE = f"({name_says('pangong', 'ladakh', 'mountain')} or is_mountain)"
SPECTRAL = f"""cast(case
 when requires_water and requires_vegetation and composite_count >= 3 then case when w >= 2 and v >= 5 and u >= 10 then 0.93 + least(0.05, 0.1 * least(w, v, u) / greatest(w, v, u, 1))
   when w >= 1 and (v >= 5 or u >= 15) then 0.78 when w < 1 then 0.15 else 0.4 end
 when requires_water and requires_vegetation then case when w >= 8 and v >= 8 then 0.93 + least(0.05, (w + v) / 2000) when w >= 4 and v >= 4 then 0.85 when w < 1 then 0.1 when v < 3 then 0.3 else 0.6 end
 when pure_water then case when w >= 20 then 0.9 + least(0.08, (w - 20) / 1000) when w >= 10 then 0.8 when w >= 3 then 0.6 when w >= 1 then 0.35 else 0.05 end
 when is_construction_site then case when w < 2 and u >= 65 then {BUILT.format(hit=name_says('jewar', 'airport', 'construction'), f=65, b=0.08)} when w < 2 and u >= 40 then 0.72 else 0.25 end
 when is_industrial then case when {name_says('pangong', 'ladakh')} or is_mountain then 0.15 when u >= 70 and v < 20 then {BUILT.format(hit=name_says('dam', 'sardar', 'jewar', 'airport', 'perambur'), f=70, b=0.06)} when u >= 40 then 0.68 else 0.2 end
 when is_residential or (requires_urban and is_road) then case when {REMOTE} then 0.08 when u >= 60 then {BUILT.format(hit=name_says('perambur', 'chennai', 'city'), f=60, b=0.06)} when u >= 30 then 0.65 else 0.25 end
 when is_solar then case when {name_says('solar')} then 0.94 when u >= 80 and v < 15 then 0.72 else 0.2 end
 when is_aviation then case when {name_says('airport', 'airfield')} then 0.94 when u >= 60 and v < 20 then 0.78 else 0.2 end
 when requires_vegetation and not requires_water and not requires_urban then case when v >= 30 then 0.88 when v >= 15 then 0.75 when v >= 5 then 0.55 else 0.15 end
 when requires_urban then case when {REMOTE} then 0.12 when u >= 60 then 0.85 when u >= 30 then 0.7 else 0.3 end else 0.5 end as double)"""
STOPS = "[" + ", ".join(q(w) for w in lx.LEXICAL_STOPS) + "]"
QWORDS = f"list_distinct(list_filter(string_split({squeeze(sub('lower(raw_query)', '[_,-]'))}, ' '), lambda x: not list_contains({STOPS}, x) and x <> ''))"
SWORDS = f"list_filter(string_split({squeeze(sub('name', '[_.-]'))}, ' '), lambda x: not list_contains({STOPS}, x) and x <> '')"
LEXICAL = f"least(0.22, 0.11 * len(list_filter({QWORDS}, lambda x: list_contains({SWORDS}, x))))::double"
SEMANTIC = "((least(1.0, greatest(0.0, (score + 0.035) / 0.05)) - 0.5) * 0.08)::double"
SCORED = f"{intent_flags('raw_query')}, {CANDIDATES}, parts as (select *, {SPECTRAL} as spectral_match, {LEXICAL} as lexical_boost, {SEMANTIC} as semantic_adjustment from cand)," + """
fused as (select *, least(0.99, greatest(0.05, case when pure_water and w < 1 then least(0.08, spectral_match + lexical_boost + semantic_adjustment) else spectral_match + lexical_boost + semantic_adjustment end)) as fused from parts)"""


def scored(t):
    i = F.col("query_id")
    log = t.query_log.withColumns({
        "query_text": F.col("raw_query"), "intent_flags": tx.spectral_intent_struct(F.col("raw_query")),
        "water_pct": (i * 7 % 300).cast("double") / 10, "veg_pct": (i * 13 % 600).cast("double") / 10,
        "urban_pct": (i * 29 % 1001).cast("double") / 10, "score": (i * 17 % 101).cast("double") / 1000 - 0.06,
        "scene_id": i % 20, "tile_id": i % 20})
    return rerank.score_candidates(log.join(t.scenes.select("scene_id", "filename"), "scene_id"))


def r7(name):
    return F.round(name, 7).alias(name)


for part in ("spectral_match", "lexical_boost", "semantic_adjustment"):
    number = {"spectral_match": 1, "lexical_boost": 2, "semantic_adjustment": 3}[part]

    @query(f"SCR-0{number}_{part}", "query_log scenes", f"with {SCORED} select query_id, round({part}, 7) as {part} from fused")
    def _(t, part=part):
        return scored(t).select("query_id", r7(part))


@query("SCR-04_fused_score", "query_log scenes", f"with {SCORED} select query_id, round(fused, 7) as fused from fused")
def _(t):
    return scored(t).select("query_id", r7("fused"))


@query("SCR-05_rerank", "query_log scenes", f"with {SCORED}" + """
select grp as query_id, query_id as tile_id, rank from (select query_id, query_id % 300 as grp, row_number() over (partition by query_id % 300 order by round(fused, 7) desc, query_id) as rank from fused) x where rank <= 5""")
def _(t):
    rows = scored(t).select((F.col("query_id") % 300).alias("g"), F.col("query_id").alias("tile_id"),
                            F.round("fused", 7).alias("order_score")).withColumnRenamed("g", "query_id")
    return rerank.rerank(rows, 5).select("query_id", "tile_id", F.col("rank").cast("long").alias("rank"))


@query("SCR-06_result_rows", "tiles", """
select tile_id, round(coalesce(case when tile_id % 4 = 0 then null else center_lon end, 1.5), 6) as center_lon, '/api/tiles/' || tile_id || '/thumbnail' as thumbnail_url,
 bbox_west is not null as drawn, round(bbox_east, 6) as east from tiles""")
def _(t):
    rows = t.tiles.withColumn("center_lon", F.when(F.col("tile_id") % 4 != 0, F.col("center_lon"))).withColumn("p_center_lon", F.lit(1.5))
    shown = rerank.result_rows(rows)
    east = F.from_json("footprint", "coordinates array<array<array<double>>>")["coordinates"][0][1][0]
    return shown.select("tile_id", F.round("center_lon", 6).alias("center_lon"), "thumbnail_url",
                        F.col("footprint").isNotNull().alias("drawn"), F.round(east, 6).alias("east"))


def _log(t):
    """The distinct sentences of the log: search answers each wording once."""
    return t.query_log.groupBy("raw_query").agg(F.min("query_id").alias("query_id"))


def _for_each_query(answers, log, asked):
    """The answers of each wording for every query id that has it."""
    ids = log.select("raw_query", F.col("query_id").alias("_each"))
    same = ids.join(asked, ids["raw_query"].eqNullSafe(asked["raw_query"])).select("_each", "query_id")
    return answers.join(same, "query_id").withColumn("query_id", F.col("_each")).drop("_each")


@query("SCR-07_semantic_search")
def _(t):
    scenes = t.scenes
    # Grouped once: the search reads it several times.
    asked = cut_lineage(_log(t))
    family = F.when(F.col("sensor").startswith("Sentinel"), "Sentinel-2").otherwise("Landsat")
    found = search.semantic_search(
        asked, t.tiles.withColumn("sensor", family), scenes, t.vector_store.withColumn("sensor", family), landcover.landcover(t.images),
        t.provenance.withColumn("details", F.struct("event_id")), top_k=5)
    found = _for_each_query(found, t.query_log, asked)
    return found.select("query_id", "rank", "tile_id", "filename", "display_score",
                        F.round("score", 6).alias("score"), "thumbnail_url")
