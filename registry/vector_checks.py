"""Vector search and upkeep (VEC-*)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from registry.base import query
from registry.filter_checks import EDGES, POLYGON, SIDES
from swathe.functions import vectors as vx
from swathe.functions.numbers import round_even
from swathe.operators import vectors
from swathe.plans import search
from swathe.session import cut_lineage, shared_dir
from swathe.sources import catalog, vector_store

# DuckDB side: cosine over two float lists, in double.
COS = ("(list_sum(list_transform(range(1, len({a}) + 1), lambda i: cast({a}[i] as double) * cast({b}[i] as double)))"
       " / (sqrt(list_sum(list_transform({a}, lambda x: cast(x as double) * cast(x as double))))"
       " * sqrt(list_sum(list_transform({b}, lambda x: cast(x as double) * cast(x as double)))){eps}))")


def cos_sql(a: str, b: str, eps: str = "") -> str:
    return COS.format(a=a, b=b, eps=eps)


def semantic(t):
    return t.vectors.where("collection = 'semantic'").drop("collection")


def r6(c):
    return F.round(c, 6)


@query("VEC-01_l2_normalize", "", f"""
select vec_id, pos, round(cast(embedding[pos] as double) / n, 6) as value from (
 select vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))) as n
 from embeddings) e, unnest(range(1, 65)) as u(pos)""")
def _(t):
    unit = t.embeddings.select("vec_id", vx.l2_normalize(F.col("embedding")).alias("v"))
    return unit.select("vec_id", F.posexplode("v").alias("p", "x")).select(
        "vec_id", (F.col("p") + 1).cast("long").alias("pos"), r6(F.col("x")).alias("value"))


@query("VEC-02_cosine", "", f"""
select a.vec_id, round({cos_sql('a.embedding', 'b.embedding', ' + 1e-7')}, 6) as cosine
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def _(t):
    e = t.embeddings
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select(
        "vec_id", r6(vx.cosine(F.col("embedding"), F.col("other"))).alias("cosine"))


@query("VEC-03_topk", "tiles vectors", f"""
select v.tile_id, round({cos_sql('v.vector', 'q.embedding')}, 6) as score
from vectors v join tiles t using (tile_id), (select embedding from embeddings where vec_id = 3) q
where v.collection = 'semantic' and t.quality_score >= 0.3 and t.cloud_cover_pct <= 45
order by {cos_sql('v.vector', 'q.embedding')} desc, v.tile_id limit 25""")
def _(t):
    probe = t.embeddings.where("vec_id = 3").select("embedding").scalar()
    keep = (F.col("collection") == "semantic") & vectors.payload_filter(min_quality=0.3, max_cloud=45.0)
    return vectors.topk(t.vector_store, probe, 25, keep).select("tile_id", r6(F.col("score")).alias("score"))


def _asked(t):
    return t.embeddings.select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


BATCH_SQL = f"""
select query_id, tile_id, rank, round(s, 6) as score from (
 select query_id, tile_id, s, row_number() over (partition by query_id order by round(s, 12) desc, tile_id) as rank from (
  select q.vec_id as query_id, v.tile_id, {cos_sql('v.vector', 'q.embedding')} as s
  from vectors v, embeddings q where v.collection = 'semantic') x) y
where rank <= 10"""


@query("VEC-04_topk_batch", "vectors", BATCH_SQL)
def _(t):
    return vectors.topk_batch(semantic(t), _asked(t), 10).select(
        "query_id", "tile_id", F.col("rank").cast("long").alias("rank"), r6(F.col("score")).alias("score"))


@query("VEC-04_topk_batch_blocks", "vectors", BATCH_SQL)
def _(t):
    best = vectors.topk_batch(semantic(t), _asked(t), 10, broadcast_queries=16, vector_block=200)
    return best.select("query_id", "tile_id", F.col("rank").cast("long").alias("rank"),
                       r6(F.col("score")).alias("score"))


@query("VEC-05_fetch_limit", "", """
select l_partkey, least(1000, greatest((l_partkey % 100 + 1) * 20, 500)) as semantic_limit,
 least(100, greatest((l_partkey % 100 + 1) * 3, 30)) as visual_limit from lineitem group by l_partkey""")
def _(t):
    semantic_limit, visual_limit = vectors.fetch_limits(F.col("l_partkey") % 100 + 1)
    return t.lineitem.select("l_partkey").distinct().select(
        "l_partkey", semantic_limit.alias("semantic_limit"), visual_limit.alias("visual_limit"))


@query("VEC-06_prompt_ensemble", "", """
select query_id, pos, round(m / n, 6) as value from (
 select *, sqrt(sum(m * m) over (partition by query_id)) as n from (
  select cast(floor(vec_id / 4) as bigint) as query_id, pos, avg(cast(embedding[pos] as double)) as m
  from embeddings, unnest(range(1, 65)) as u(pos) group by 1, 2) a) b""")
def _(t):
    e = t.embeddings.select(
        F.floor(F.col("vec_id") / 4).alias("query_id"), F.col("embedding").alias("vector"))
    return vectors.prompt_ensemble(e).select(
        "query_id", F.posexplode("vector").alias("p", "x")).select(
        "query_id", (F.col("p") + 1).cast("long").alias("pos"), r6(F.col("x")).alias("value"))


@query("VEC-07_embed_text", "query_log", """
, words as (select query_id, unnest(string_split(trim(regexp_replace(lower(raw_query), '\\s+', ' ', 'g')), ' ')) as w from query_log),
counts as (select query_id, cast(cast('0x' || substr(md5(w), 1, 8) as bigint) % 64 as bigint) as pos, count(*) as n from words group by 1, 2)
select query_id, pos, round(n / sqrt(sum(n * n) over (partition by query_id)), 6) as value from counts""".replace(", words as", "with words as", 1))
def _(t):
    v = t.query_log.select("query_id", vectors.hashed_text_vector(F.col("raw_query")).alias("v"))
    return v.select("query_id", F.posexplode("v").alias("p", "x")).where("x > 0").select(
        "query_id", F.col("p").cast("long").alias("pos"), r6(F.col("x")).alias("value"))


@query("VEC-07_embed_pixels", "images", """
with bins as (
 select tile_id, 0 as band, floor(r / 16) as bin, count(*) as n from images group by all
 union all select tile_id, 1, floor(g / 16), count(*) from images group by all
 union all select tile_id, 2, floor(b / 16), count(*) from images group by all)
select tile_id, cast(band * 16 + bin as bigint) as pos,
 round(n / sqrt(sum(n * n) over (partition by tile_id)), 6) as value from bins""")
def _(t):
    v = vectors.pixel_histogram_vectors(t.images)
    return v.select("tile_id", F.posexplode("vector").alias("p", "x")).where("x > 0").select(
        "tile_id", F.col("p").cast("long").alias("pos"), r6(F.col("x")).alias("value"))


@query("VEC-07_embed_model", "", """
select doc_id, length(text) as chars, cast(length(text) - length(replace(text, ' ', '')) as bigint) as blanks from documents""")
def _(t):
    """A caller's model through the batch hook: here two text statistics."""
    import numpy as np

    def load():
        return lambda texts: np.column_stack([texts.str.len(), texts.str.count(" ")])

    v = vectors.embed(t.documents, load, "doc_id", "text")
    return v.select("doc_id", F.col("vector")[0].cast("long").alias("chars"),
                    F.col("vector")[1].cast("long").alias("blanks"))


@query("VEC-08_pending_tiles", "tiles vectors", """
select tile_id from tiles t where
 (select count(distinct collection) from vectors v where v.tile_id = t.tile_id) < 2""")
def _(t):
    return vectors.pending_tiles(t.tiles, t.vectors, ["semantic", "visual"]).select("tile_id")


@query("VEC-09_build_payload", "tiles", """
select tile_id, sensor, cast(acquisition_date as string) as day,
 json_extract_string(g, '$.type') as kind,
 round(cast(json_extract(g, '$.coordinates[0][2][0]') as double), 6) as east,
 round(cast(json_extract(g, '$.coordinates[0][2][1]') as double), 6) as north,
 cast(json_array_length(json_extract(g, '$.coordinates[0]')) as bigint) as corners
from (select *, case when bbox_west is not null then json_object('type', 'Polygon', 'coordinates', json_array(json_array(
 json_array(bbox_west, bbox_south), json_array(bbox_east, bbox_south), json_array(bbox_east, bbox_north),
 json_array(bbox_west, bbox_north), json_array(bbox_west, bbox_south)))) end as g from tiles) x""")
def _(t):
    g = F.from_json("geometry", "type string, coordinates array<array<array<double>>>")
    p = vectors.build_payload(t.tiles).withColumn("g", g)
    corner = F.col("g.coordinates")[0][2]
    return p.select(
        "tile_id", "sensor", F.col("acquisition_date").cast("string").alias("day"),
        F.col("g.type").alias("kind"), F.round(corner[0], 6).alias("east"),
        F.round(corner[1], 6).alias("north"),
        F.when(F.col("g").isNotNull(), F.size(F.col("g.coordinates")[0]).cast("long")).alias("corners"))


@query("VEC-10_mark_embedded", "tiles vectors", """
select t.tile_id, case when b.m is not null then t.tile_id else t.vector_id end as vector_id,
 case when b.m is not null then 'hashed-64' end as embedding_model
from tiles t left join (select tile_id, max(embedded_at) as m from vectors where collection = 'visual' and tile_id % 2 = 0 group by 1) b using (tile_id)""")
def _(t):
    batch = t.vectors.where("collection = 'visual' and tile_id % 2 = 0").withColumn(
        "embedded_at", F.lit("2024-01-01").cast("date"))
    return vectors.mark_embedded(t.tiles, batch, "hashed-64").select(
        "tile_id", "vector_id", "embedding_model")


SIMILAR_WHERE = """t.sensor in ('Sentinel-2A', 'Sentinel-2B', 'Landsat-9') and t.quality_score >= 0.1 and t.cloud_cover_pct <= 55
 and t.center_lon between 69 and 76 and t.center_lat between 9 and 11 and v.tile_id <> 7"""


@query("VEC-11_similar_tiles", "tiles scenes vectors", f"""
select tile_id, filename, round_even(s, 4) as score, rank from (
 select v.tile_id, c.filename, {cos_sql('v.vector', 'q.vector')} as s,
  row_number() over (order by {cos_sql('v.vector', 'q.vector')} desc, v.tile_id) as rank
 from vectors v join tiles t using (tile_id) join scenes c on c.scene_id = t.scene_id,
  (select vector from vectors where collection = 'visual' and tile_id = 7) q
 where v.collection = 'visual' and {SIMILAR_WHERE}) x where rank <= 12""")
def _(t):
    hits = search.similar_tiles(
        t.vector_store, t.tiles, t.scenes, 7, 12, sensors=["Sentinel-2A", "Sentinel-2B", "Landsat-9"],
        min_quality=0.1, max_cloud=55.0, bbox=(76.0, 11.0, 69.0, 9.0))
    return hits.select("tile_id", "filename", "score", F.col("rank").cast("long").alias("rank"))


@query("VEC-12_search_by_vector", "tiles scenes vectors", f"""with {EDGES} {SIDES},
inside as (select tile_id from sides group by 1 having bool_or(x0 <= e and x1 >= w and y0 <= n and y1 >= s and lo <= 0 and hi >= 0) or count(*) filter (corner_hit) % 2 = 1),
near as (select v.tile_id, t.scene_id, {cos_sql('v.vector', 'q.e')} as s from vectors v join tiles t using (tile_id), (select embedding[1:32] as e from embeddings where vec_id = 11) q
 where v.collection = 'visual' and t.center_lon between 69.95 and 71.35 and t.center_lat between 9.99 and 10.32)
select tile_id, filename, round_even(s, 4)::double as score, row_number() over (order by s desc, tile_id) as rank from near join inside using (tile_id) join scenes using (scene_id) order by s desc, tile_id limit 8""")
def _(t):
    probe = t.embeddings.where("vec_id = 11").select(F.slice("embedding", 1, 32)).scalar()
    hits = search.search_by_vector(t.vector_store, t.tiles, t.scenes, probe, 8, polygon=POLYGON)
    return hits.select("tile_id", "filename", "score", F.col("rank").cast("long").alias("rank"))


@query("VEC-13_semantic_distance", "vectors", f"""
with p as (select vec_id as before_tile, vec_id + 25 as after_tile from embeddings)
select before_tile, after_tile, round(case when a.vector is null or b.vector is null then 0.5 else least(1.0, greatest(0.1, 50 * (1.0 - {cos_sql('a.vector', 'b.vector', ' + 1e-7')}))) end, 6) as distance
from p left join (select * from vectors where collection = 'semantic') a on a.tile_id = before_tile
left join (select * from vectors where collection = 'semantic') b on b.tile_id = after_tile""")
def _(t):
    pairs = t.embeddings.select(
        F.col("vec_id").alias("before_tile"), (F.col("vec_id") + 25).alias("after_tile"))
    both = vectors.pair_vectors(pairs, semantic(t))
    return both.select("before_tile", "after_tile", r6(vectors.semantic_distance(
        F.col("before_vector"), F.col("after_vector"))).alias("distance"))


@query("VEC-14_query_pair_similarity", "vectors", f"""
select v.tile_id, round(least(0.95, greatest(0.15, ({cos_sql('q.embedding', 'v.vector', ' + 1e-7')} + 0.15) * 1.4)), 6) as query_match
from vectors v, (select embedding from embeddings where vec_id = 5) q where v.collection = 'semantic'""")
def _(t):
    probe = t.embeddings.where("vec_id = 5").select("embedding").scalar()
    return semantic(t).withColumn("probe", probe).select("tile_id", r6(vectors.query_similarity(
        F.col("probe"), F.col("vector"))).alias("query_match"))


@query("VEC-15_score_range", "vectors", f"""
select t.label, count(*) as total, round(min(s), 6) as min_score, round(max(s), 6) as max_score, round(avg(s), 6) as mean_score
from (select v.tile_id, {cos_sql('v.vector', 'q.embedding')} as s from vectors v,
 (select embedding from embeddings where vec_id = 8) q where v.collection = 'semantic') x
join embeddings t on t.vec_id = x.tile_id group by t.label""")
def _(t):
    probe = t.embeddings.where("vec_id = 8").select("embedding").scalar()
    scored = semantic(t).withColumn("probe", probe).withColumn(
        "score", vectors.similarity(F.col("vector"), F.col("probe"))).join(
        t.embeddings.select(F.col("vec_id").alias("tile_id"), "label"), "tile_id")
    stats = vectors.score_range(scored, ["label"])
    return stats.select("label", "total", *[r6(F.col(c)).alias(c) for c in (
        "min_score", "max_score", "mean_score")])


@query("SRC-11_upsert_stored", "vectors tiles", """
with known as (select v.* from vectors v join tiles using (tile_id)),
both_ as (select collection, tile_id, embedded_at, 0 as fresh, vector[1] as head from known
 union all select collection, tile_id, cast((tile_id * 11) % 400 as int), 1, -vector[1] from known where tile_id % 3 = 0)
select collection, tile_id, embedded_at, round(cast(head as double), 6) as head from (
 select *, row_number() over (partition by collection, tile_id order by embedded_at desc, fresh desc) as rn from both_) x where rn = 1""")
def _(t):
    """Twice the same batch into a stored table, by buckets."""
    store = vector_store.VectorStore(t.spark, f"{shared_dir(t.spark)}/upserted-{uuid.uuid4().hex}", buckets=4).create(
        vector_store.with_payload(t.vectors, t.tiles))
    fresh = store.read().where("tile_id % 3 = 0").withColumns({
        "vector": F.transform("vector", lambda x: -x), "embedded_at": ((F.col("tile_id") * 11) % 400).cast("int")})
    batch = cut_lineage(fresh)
    store.upsert(batch)
    store.upsert(batch)
    return store.read().select("collection", "tile_id", "embedded_at", F.round(
        F.col("vector")[0].cast("double"), 6).alias("head"))


@query("SRC-11_upsert_vectors", "vectors", """
with both_ as (select collection, tile_id, embedded_at, 0 as fresh, vector[1] as head from vectors
 union all select collection, tile_id, cast((tile_id * 11) % 400 as int), 1, -vector[1] from vectors where tile_id % 3 = 0)
select collection, tile_id, embedded_at, round(cast(head as double), 6) as head from (
 select *, row_number() over (partition by collection, tile_id order by embedded_at desc, fresh desc) as rn from both_) x where rn = 1""")
def _(t):
    batch = t.vectors.where("tile_id % 3 = 0").select(
        "collection", "tile_id", F.transform("vector", lambda x: -x).alias("vector"),
        ((F.col("tile_id") * 11) % 400).cast("int").alias("embedded_at"))
    merged = catalog.upsert_vectors(t.vectors, batch)
    return merged.select("collection", "tile_id", "embedded_at",
                         F.round(F.col("vector")[0].cast("double"), 6).alias("head"))


@query("SRC-12_fetch_vectors", "vectors tiles", """
select v.collection, v.tile_id, round(cast(v.vector[1] as double), 6) as head from vectors v
where v.tile_id in (select tile_id from tiles where is_valid and quality_score >= 0.5)""")
def _(t):
    ids = t.tiles.where("is_valid and quality_score >= 0.5")
    return catalog.fetch_vectors(t.vectors, ids).select(
        "collection", "tile_id", F.round(F.col("vector")[0].cast("double"), 6).alias("head"))


@query("SRC-12_vector_exists", "vectors tiles", """
select tile_id, tile_id in (select tile_id from vectors) as found from tiles""")
def _(t):
    return catalog.vector_exists(t.tiles, t.vectors)


@query("SRC-14_prune_orphans_kept", "vectors tiles", """
select collection, tile_id from vectors where tile_id in (select tile_id from tiles)""")
def _(t):
    return catalog.prune_orphan_vectors(t.vectors, t.tiles)[0].select("collection", "tile_id")


@query("SRC-14_prune_orphans_removed", "vectors tiles", """
select collection, count(*) as removed from vectors where tile_id not in (select tile_id from tiles) group by collection""")
def _(t):
    return catalog.prune_orphan_vectors(t.vectors, t.tiles)[1]


@query("AGG-09_separability", "", f"""
select a.vec_id, round(c, 6) as cosine, case when kind = 'high_sim' then c >= 0.65 else c <= 0.55 end as passed from (
 select a.vec_id, {cos_sql('a.embedding', 'b.embedding', ' + 1e-7')} as c,
  case when a.label = b.label then 'high_sim' else 'low_sim' end as kind
 from embeddings a join embeddings b on b.vec_id = a.vec_id + 3) a""")
def _(t):
    e = t.embeddings
    other = e.select((F.col("vec_id") - 3).alias("vec_id"), F.col("embedding").alias("b"),
                     F.col("label").alias("other_label"))
    pairs = e.join(other, "vec_id").select(
        "vec_id", F.col("embedding").alias("a"), "b",
        F.when(F.col("label") == F.col("other_label"), "high_sim").otherwise("low_sim").alias("pair_type"))
    return vectors.separability(pairs).select("vec_id", r6(F.col("cosine")).alias("cosine"), "passed")
