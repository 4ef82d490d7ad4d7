"""Query understanding over logs and documents (QRY-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import query
from swathe import lexicon as lx
from swathe.functions import geometry
from swathe.functions import text as tx
from swathe.operators import queries, spelling

SPACES = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(text: str, pattern: str, to: str = " ", flags: str = "g") -> str:
    return f"regexp_replace({text}, {q(pattern)}, {q(to)}, '{flags}')"


def squeeze(text: str) -> str:
    return f"trim({sub(text, SPACES)})"


def clean(text: str) -> str:
    return squeeze(f"lower({text})")


def punct(text: str) -> str:
    text = sub(text, r"""[\[\]\(\)\{\}"'/\\&,;:!?*~#^+=<>|]""")
    for _ in range(2):
        text = sub(text, r"(\p{Nd})\.(\p{Nd})", r"\1" + "\x01" + r"\2")
    return squeeze(f"replace(replace({text}, '.', ' '), chr(1), '.')")


def synonyms(text: str) -> str:
    for phrase, term in sorted(lx.SYNONYMS.items(), key=lambda rule: -len(rule[0])):
        text = sub(text, rf"\b{phrase}\b", term)
    return text


def lemmas(text: str) -> str:
    known = " ".join(f"when {q(k)} then {q(v)}" for k, v in {**lx.DOMAIN_LEMMAS, **lx.PLURAL_EXCEPTIONS}.items())
    rule = (f"case w {known} else case when w like '%ies' and length(w) > 4 then left(w, length(w) - 3) || 'y' "
            "when length(w) > 4 and (w like '%shes' or w like '%ches' or w like '%xes' or w like '%zes') then left(w, length(w) - 2) "
            "when w like '%s' and w not like '%ss' and length(w) > 3 then left(w, length(w) - 1) else w end end")
    return f"array_to_string(list_transform(string_split({squeeze(text)}, ' '), lambda w: {rule}), ' ')"


def any_of(tokens: str, words) -> str:
    return f"list_has_any({tokens}, [{', '.join(q(w) for w in words)}])"


def says(text: str, phrases) -> str:
    return "(" + " or ".join(f"contains({text}, {q(p)})" for p in phrases) + ")"


@query("QRY-01_cleanup", "", f"select doc_id, md5({clean('text')}) as cleaned, length({clean('text')}) as n from documents")
def _(t):
    c = tx.cleanup(F.col("text"))
    return t.documents.select("doc_id", F.md5(c).alias("cleaned"), F.length(c).cast("long").alias("n"))


@query("QRY-02_normalize_punctuation", "", f"select doc_id, md5({punct('text')}) as cleaned from documents")
def _(t):
    return t.documents.select("doc_id", F.md5(tx.normalize_punctuation(F.col("text"))).alias("cleaned"))


@query("QRY-03_apply_synonyms", "query_log", f"select query_id, {synonyms(punct(clean('raw_query')))} as text from query_log")
def _(t):
    return queries.by_text(t.query_log, "raw_query", lambda texts: texts.withColumn(
        "text", tx.apply_synonyms(tx.normalize_punctuation(tx.cleanup(F.col("raw_query")))))).select("query_id", "text")


@query("QRY-04_lemmatize", "", f"select doc_id, md5({lemmas(clean('text'))}) as lemmas from documents")
def _(t):
    return t.documents.select("doc_id", F.md5(tx.lemmatize(tx.cleanup(F.col("text")))).alias("lemmas"))


NORMAL = lambda text: lemmas(synonyms(punct(clean(text))))


@query("QRY-05_normalize", "query_log", f"select query_id, {NORMAL('raw_query')} as text from query_log")
def _(t):
    return queries.by_text(t.query_log, "raw_query", lambda texts: texts.withColumn(
        "text", tx.normalize(F.col("raw_query")))).select("query_id", "text")


VOCAB = "vocab as (select unnest([" + ", ".join(q(w) for w in lx.spelling_vocabulary()) + "]) as candidate)"
WEIGHT = "(case c.candidate " + " ".join(f"when {q(w)} then {v}" for w, v in lx.SPELLING_WEIGHTS.items()) + " else 1.0 end)::double"
DOC_TOKENS = f"""tok as materialized (select distinct token from (select lower(regexp_replace(regexp_replace(w, '^[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}]+', ''), '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}]+$', '')) as token
 from (select unnest(string_split({squeeze('text')}, ' ')) as w from documents) a) b where token <> '')"""


# DuckDB measures bytes; no candidate has a non-ASCII letter, so any one ASCII sign may stand for it.
ASCII = "regexp_replace(token, '[^\\x00-\\x7f]', '#', 'g')"


def doc_tokens(t):
    # Distinct before the ends are cut: a pattern costs far more than a look-up.
    words = t.documents.select(F.explode(tx.tokens_of(F.col("text"))).alias("w")).distinct()
    return words.select(F.lower(spelling.core_word(F.col("w"))).alias("token")).where("token <> ''")


@query("QRY-06_damerau_levenshtein_join", "", f"with {VOCAB}, {DOC_TOKENS}" + f"""
select token, candidate, distance from (select token, candidate, cast(damerau_levenshtein({ASCII}, candidate) as int) as distance
 from tok join vocab on abs(length(token) - length(candidate)) <= 2) x where distance <= 2""")
def _(t):
    pairs = spelling.damerau_levenshtein_join(doc_tokens(t), spelling.vocabulary_frame(t.spark))
    return pairs.select("token", "candidate", "distance")


@query("QRY-06_damerau_levenshtein_keys", "query_log", rf"""with {VOCAB}, ltok as (select distinct lower(w) as token from (select unnest(string_split({squeeze('raw_query')}, ' ')) as w from query_log) a where w <> '')
select token, candidate, distance from (select token, candidate, cast(damerau_levenshtein(token, candidate) as int) as distance from ltok join vocab on abs(length(token) - length(candidate)) <= 2) x where distance <= 2""")
def _(t):
    """The path for large vocabularies."""
    words = t.query_log.select(F.explode(tx.tokens_of(F.lower("raw_query"))).alias("token"))
    pairs = spelling.damerau_levenshtein_join(
        words, spelling.vocabulary_frame(t.spark), small_vocabulary=0)
    return pairs.select("token", "candidate", "distance")


def letters(word: str) -> str:
    """The set of the letters a to z in a word, as bits. An edit changes at most two of them."""
    return "(" + " + ".join(f"case when contains({word}, '{c}') then {1 << i} else 0 end"
                            for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")) + ")"


def corrections_sql(tokens: str) -> str:
    confusable = " ".join(f"when {q(k)} then {q(v)}" for k, v in lx.CONFUSABLES.items())
    keys = ", ".join(q(k) for k in lx.CONFUSABLES)
    return f"""
known as materialized (select candidate, {letters('candidate')} as cmask from vocab),
open_ as materialized (select token, {letters('token')} as tmask from {tokens}
  where length(token) >= 4 and token not in (select candidate from vocab) and token not in ({keys}) and not regexp_full_match(token, '[\\d.\\-]+')),
fuzzy as (select token, candidate, d, row_number() over (partition by token order by (1.0::double - d / greatest(length(token), length(candidate)) + case when same then 0.1::double else 0.0 end) * w desc, candidate) as rn, same from (
  select token, c.candidate, damerau_levenshtein({ASCII}, c.candidate) as d, left(token, 1) = left(c.candidate, 1) as same, {WEIGHT} as w
  from open_ join known c on abs(length(token) - length(c.candidate)) <= 2 and bit_count(xor(tmask, cmask)) <= 4) x
 where d <= case when length(token) >= 5 then 2 else 1 end and (d < 2 or same)),
fixes as (select token, candidate as corrected, round(case when d = 1 then 0.95 else 0.8 end + case when same then 0.03 else 0 end, 2)::double as confidence, cast(d as int) as distance from fuzzy where rn = 1
 union all select token, corrected, 0.96::double, cast(damerau_levenshtein(token, corrected) as int) from (select token, case token {confusable} end as corrected from {tokens} where token in ({keys})) y)"""


@query("QRY-07_correct_tokens", "", f"with {VOCAB}, {DOC_TOKENS}, {corrections_sql('tok')} select * from fixes")
def _(t):
    return spelling.correct_tokens(doc_tokens(t))


LOG_FIXES = rf"""{VOCAB},
parts as (select query_id, i, w, regexp_replace(regexp_replace(w, '^\W+', ''), '\W+$', '') as core from (
 select query_id, unnest(string_split({squeeze('raw_query')}, ' ')) as w, generate_subscripts(string_split({squeeze('raw_query')}, ' '), 1) as i from query_log) a),
ltok as (select distinct lower(core) as token from parts where core <> ''),
{corrections_sql('ltok')},
words as (select query_id, i, core, f.corrected, f.distance, case when f.corrected is null then w else regexp_extract(w, '^\W*') || f.corrected || regexp_extract(w, '\W*$') end as w2 from parts left join fixes f on f.token = lower(core)),
fixed as (select query_id, string_agg(w2, ' ' order by i) as joined, count(corrected) as n, string_agg(core || '>' || corrected || ':' || distance, ',' order by i) filter (corrected is not null) as notes from words group by 1),
corrected as (select l.query_id, l.raw_query, n > 0 as is_corrected, coalesce(notes, '') as notes, case when n > 0 then joined else trim(raw_query) end as text from query_log l join fixed using (query_id))"""


@query("QRY-08_correct_queries", "query_log", f"with {LOG_FIXES} select query_id, is_corrected, notes, text as corrected_query from corrected")
def _(t):
    c = spelling.correct_queries(t.query_log)
    note = F.transform("corrections", lambda x: F.concat(
        x["original_word"], F.lit(">"), x["corrected_word"], F.lit(":"), x["edit_distance"].cast("string")))
    return c.select("query_id", "is_corrected", F.array_join(note, ",").alias("notes"), "corrected_query")


PROPER = " ".join(f"when {q(n)} then replace(w, {q(n)}, {q(n.title())})" for n in lx.PROPER_NAMES)


@query("QRY-09_did_you_mean", "query_log", rf"""with {LOG_FIXES} select query_id, case when is_corrected then 'Did you mean: ' ||
 array_to_string(list_transform(string_split({squeeze('text')}, ' '), lambda w: case regexp_replace(lower(w), '\W', '', 'g') {PROPER} else w end), ' ') || '?' end as did_you_mean from corrected""")
def _(t):
    return spelling.correct_queries(t.query_log).select("query_id", "did_you_mean")


def alias_rows() -> str:
    rows, place = [], 0
    for name, aliases, kind, box in sorted(lx.PLACES, key=lambda p: -len(p[0])):
        for alias in sorted([name] + aliases, key=lambda n: -len(n)):
            pattern = r"\b" + alias.lower() + r"\b"
            rows.append(f"({len(rows)}, {q(name)}, {q(kind)}, {q(pattern)}, {', '.join(f'{float(v)}::double' for v in box)})")
    return "places(rank, name, kind, pattern, west, south, east, north) as (values " + ", ".join(rows) + ")"


def located(source: str, text: str) -> str:
    return f"""{alias_rows()},
located as (select query_id, {text} as text, p.name, p.kind, p.west, p.south, p.east, p.north from {source} left join (
 select query_id, min(rank) as rank from {source} join places on regexp_matches(lower({text}), pattern) group by 1) h using (query_id) left join places p using (rank))"""


@query("QRY-10_resolve_places", "query_log", f"with {located('query_log', 'raw_query')} select query_id, name, kind, west, north from located")
def _(t):
    p = F.col("p")
    return t.query_log.select("query_id", tx.resolve_place(F.col("raw_query")).alias("p")).select(
        "query_id", p["name"].alias("name"), p["kind"].alias("kind"), p["west"].alias("west"), p["north"].alias("north"))


def stripped(text: str, place: str) -> str:
    cases = []
    for name, aliases, _, _ in lx.PLACES:
        body = text
        for alias in sorted([name] + aliases, key=lambda n: -len(n)):
            body = sub(body, r"\b(in|at|within|inside|around|near|across|along|through|of)\s+" + alias + r"\b", " ", "gi")
            body = sub(body, r"\b" + alias + r"\b", " ", "gi")
        cases.append(f"when {q(name)} then {body}")
    return squeeze(f"case {place} {' '.join(cases)} else {text} end")


@query("QRY-11_strip_places", "query_log", f"with {located('query_log', 'raw_query')} select query_id, {stripped('text', 'name')} as text from located")
def _(t):
    raw = F.col("raw_query")
    return t.query_log.withColumn("p", tx.resolve_place(raw)).select(
        "query_id", tx.strip_place(raw, F.col("p")).alias("text"))


@query("QRY-12_bbox_wkt", "stac_items", """
select item_id, 'POLYGON((' || w || ' ' || s || ', ' || e || ' ' || s || ', ' || e || ' ' || n || ', ' || w || ' ' || n || ', ' || w || ' ' || s || '))' as wkt
from (select item_id, cast(bbox_west as string) as w, cast(bbox_south as string) as s, cast(bbox_east as string) as e, cast(bbox_north as string) as n from stac_items) x""")
def _(t):
    return t.stac_items.select("item_id", geometry.box_wkt(
        F.col("bbox_west"), F.col("bbox_south"), F.col("bbox_east"), F.col("bbox_north")).alias("wkt"))


def temporal(text: str) -> str:
    pick = lambda p, g=1: f"nullif(regexp_extract(lower({text}), {q(p)}, {g}), '')"
    between = r"\bbetween\s+(\d{4})\s+(?:and|to)\s+(\d{4})\b"
    return f"""{pick(between, 1)} as y1, {pick(between, 2)} as y2, {pick(r'\b(?:after|since|from|post)\s+(\d{4})\b')} as ya,
 {pick(r'\b(?:before|prior to|until|up to)\s+(\d{4})\b')} as yb, {pick(r'\bin\s+(\d{4})\b')} as yi"""


YEARS = """case when y1 is not null then y1 when ya is not null then ya when yb is null then yi end || '-01-01 00:00:00' as start_date,
 case when y1 is not null then y2 when yb is not null then yb when ya is null then yi end || '-12-31 23:59:59' as end_date,
 case when y1 is not null then y1 || '-' || y2 else coalesce(ya, yb, yi) end as time_anchor"""


@query("QRY-13_temporal_bounds", "query_log", f"select query_id, {YEARS} from (select query_id, {temporal('raw_query')} from query_log) x")
def _(t):
    b = tx.temporal_bounds(F.col("raw_query"))
    return t.query_log.select("query_id", *[
        (c if n == "time_anchor" else F.date_format(c, "yyyy-MM-dd HH:mm:ss")).alias(n) for n, c in b.items()])


def hints(text: str) -> str:
    low = f"lower({text})"
    return f"""case when {says(low, lx.CLOUDLESS_PHRASES)} then 5.0::double when contains({low}, 'low cloud') then 15.0::double end as max_cloud_cover,
 case when {says(low, ['high quality', 'crisp', 'clear'])} then 0.75::double end as min_quality,
 nullif(array_to_string(list_filter([case when contains({low}, 'sentinel') then 'Sentinel-2' end, case when {says(low, ['landsat-8', 'landsat 8'])} then 'Landsat-8' when contains({low}, 'landsat') then 'Landsat' end,
  case when contains({low}, 'planet') then 'PlanetScope' end], lambda s: s is not null), ','), '') as sensors"""


@query("QRY-14_quality_sensor_hints", "query_log", f"select query_id, {hints('raw_query')} from query_log")
def _(t):
    h = tx.quality_hints(F.col("raw_query"))
    return t.query_log.select("query_id", h["max_cloud_cover"].alias("max_cloud_cover"),
                              h["min_quality"].alias("min_quality"), F.array_join(h["sensors"], ",").alias("sensors"))


def relation(text: str) -> str:
    return "case " + " ".join(f"when regexp_matches(lower({text}), {q(p)}) then {q(n)}" for n, p in lx.RELATIONS) + " end"


@query("QRY-15_relationship", "query_log", f"select query_id, {relation('raw_query')} as relationship from query_log")
def _(t):
    return t.query_log.select("query_id", tx.relationship(F.col("raw_query")).alias("relationship"))


CHANGE = f"""({any_of('tokens', lx.CHANGE_WORDS)} or (list_contains(tokens, 'between') and {any_of('tokens', ['and', 'to'])}) or list_contains(tokens, 'since')
 or (list_contains(tokens, 'after') and time_anchor is not null) or (relationship is not null and {any_of('tokens', lx.RELATED_CHANGE_WORDS)}))"""


def base(source: str, text: str, keep: str = "") -> str:
    """CTEs that end in ``parsed``: everything the parser reads from a text."""
    return f"""
p0 as (select query_id, {text} as text{keep}, {NORMAL(text)} as normalized_query, {relation(text)} as relationship, {temporal(text)}, {hints(text)} from {source}),
p1 as (select *, string_split(normalized_query, ' ') as tokens, {YEARS} from p0),
p2 as (select *, {CHANGE} as is_change from p1),
p3 as (select *, case when is_change then 'change_search' else 'semantic_search' end as intent,
 case when {any_of('tokens', ['demolition', 'demolished'])} then 'demolition' when {any_of('tokens', ['vegetation_clearance', 'clearance', 'deforestation'])} then 'vegetation_clearance'
  when {any_of('tokens', ['expansion', 'development'])} then case when {any_of('tokens', ['urban'])} then 'urban_expansion' when {any_of('tokens', ['airport', 'runway'])} then 'airport_expansion'
   when {any_of('tokens', ['solar'])} then 'solar_development' when {any_of('tokens', ['road'])} then 'road_expansion' else 'urban_expansion' end
  when {any_of('tokens', ['construction', 'building'])} then 'construction' when {any_of('tokens', ['water', 'reservoir', 'lake', 'river'])} then 'water' when {any_of('tokens', ['road', 'highway'])} then 'road' end as t0,
 case {' '.join(f"when {any_of('tokens', words)} then {q(name)}" for words, name in tx.CONCEPT_RULES)} end as c0,
 {any_of('tokens', lx.NEEDS_WATER)} or coalesce(relationship = 'near_water', false) as requires_water,
 {any_of('tokens', lx.NEEDS_VEGETATION)} as requires_vegetation,
 {any_of('tokens', lx.NEEDS_URBAN)} or coalesce(relationship in ('near_road', 'near_urban'), false) as requires_urban from p2),
parsed as (select *, case when is_change then coalesce(t0, c0) else t0 end as target, case when is_change then c0 else coalesce(c0, t0) end as concept from p3)"""


def _parsed(t):
    """The raw log parsed without spelling correction."""
    return queries.parse_corrected(t.query_log.withColumn("corrected_query", F.col("raw_query")))


@query("QRY-16_intent", "query_log", f"with {base('query_log', 'raw_query')} select query_id, intent from parsed")
def _(t):
    return _parsed(t).select("query_id", "intent")


@query("QRY-17_target_concept", "query_log", f"with {base('query_log', 'raw_query')} select query_id, target, concept from parsed")
def _(t):
    return _parsed(t).select("query_id", "target", "concept")


@query("QRY-18_landcover_requirements", "query_log", f"with {base('query_log', 'raw_query')} select query_id, requires_water, requires_vegetation, requires_urban from parsed")
def _(t):
    return _parsed(t).select("query_id", "requires_water", "requires_vegetation", "requires_urban")


def canonical(name: str) -> str:
    """Canonical text from the columns of ``parsed`` and a place name."""
    text = "normalized_query"
    for noise in (r"\b(after|since|before|between|from|until|in|to|and|post)\s+\d{4}\b", r"\b\d{4}\b",
                  r"\b(cloud-free|cloudless|no clouds|clear sky|sentinel-2|sentinel|landsat-8|landsat)\b"):
        text = sub(text, noise, "")
    text = squeeze(text)
    bare = f"regexp_replace({text}, '\\b(in|at|within|inside|near|around|across|along|of)\\s+' || lower({name}) || '\\b', ' ', 'g')"
    bare = f"regexp_replace({bare}, '\\b' || lower({name}) || '\\b', ' ', 'g')"
    bare = squeeze(sub(sub(bare, r"\b(in|at|within|of|near|around)\s*$", "", ""), r"^\s*(in|at|within|of|near|around)\b", "", ""))
    text = f"case when {name} is null then {text} else {bare} end"
    return f"""(select trim(case when u = '' then coalesce(nullif(concat_ws(' ', concept, target), ''), normalized_query) else u end) from (
 select case when relationship = 'near_road' and not contains(s, 'road') then s || ' road infrastructure' when relationship = 'near_water' and not contains(s, 'water') then s || ' water surface' else s end as u
 from (select {text} as s) a) b)"""


@query("QRY-19_canonical_text", "query_log", f"with {located('query_log', 'raw_query')}, {base('query_log', 'raw_query')} select query_id, {canonical('l.name')} as canonical_text from parsed join located l using (query_id)")
def _(t):
    return _parsed(t).select("query_id", "canonical_text")


FULL = f"with {LOG_FIXES}, {located('corrected', 'text')}, {base('corrected', 'text', ', raw_query, is_corrected')}"


@query("QRY-20_parse_queries", "query_log", FULL + f"""
select query_id, is_corrected, normalized_query, intent, target, concept, relationship, l.name as location, l.kind as location_type, l.west as location_west,
 start_date, end_date, time_anchor, max_cloud_cover, min_quality, requires_water, requires_vegetation, requires_urban, {canonical('l.name')} as canonical_text
from parsed join located l using (query_id)""")
def _(t):
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return queries.parse_queries(t.query_log).select(
        "query_id", "is_corrected", "normalized_query", "intent", "target", "concept", "relationship",
        "location", "location_type", "location_west", day("start_date"), day("end_date"), "time_anchor",
        "max_cloud_cover", "min_quality", "requires_water", "requires_vegetation", "requires_urban", "canonical_text")


def intent_flags(text: str) -> str:
    low = f"lower({text})"
    words = f"string_split({squeeze(sub(low, r'[&/,.-]'))}, ' ')"
    has = {k: any_of(words, v) for k, v in lx.INTENT_WORDS.items()}
    said = {k: says(low, v) for k, v in lx.INTENT_PHRASES.items()}
    return f"""
i0 as (select *, {has['water']} or {said['water']} as requires_water, {has['vegetation']} or {said['vegetation']} as requires_vegetation, {has['aviation']} as is_aviation,
 {has['solar']} or {said['solar']} as is_solar, {has['mountain']} as is_mountain, {has['industrial']} as is_industrial, {has['residential']} as is_residential, {has['road']} as is_road,
 {has['construction_site']} as is_construction_site, {has['urban']} or {said['urban']} as town from query_log),
i1 as (select *, (town or is_industrial or is_residential or is_road or is_construction_site) and not (is_aviation or is_solar) as requires_urban from i0),
intents as (select *, requires_water and not (requires_urban or requires_vegetation or is_aviation or is_solar or is_construction_site) as pure_water,
 cast(requires_water::int + requires_vegetation::int + (requires_urban or is_road or is_residential or is_industrial)::int as int) as composite_count from i1)"""


FLAGS = ["requires_water", "requires_vegetation", "requires_urban", "pure_water", "is_aviation", "is_solar", "is_mountain",
         "is_industrial", "is_residential", "is_road", "is_construction_site", "composite_count"]


@query("QRY-21_spectral_intent", "query_log", f"with {intent_flags('raw_query')} select query_id, {', '.join(FLAGS)} from intents")
def _(t):
    return t.query_log.select("query_id", *[c.alias(n) for n, c in tx.spectral_intent(F.col("raw_query")).items()])


ANSWERS_SQL = """
answers as (select query_id, case query_id % 7
 when 0 then '```json' || chr(10) || '{"intent": "change_analysis", "concepts": ["Solar"], "target": "Solar Farm", "relationships": []}' || chr(10) || '```'
 when 1 then '{"intent": "semantic_search", "concepts": ["unknown thing"], "relationships": ["near_road"]}' when 2 then 'sorry, I cannot' when 3 then '{"intent": "launch", "concepts": []}'
 when 4 then '```' || chr(10) || '{"intent": "temporal_search", "concepts": ["forest", "river"], "target": null}' || '```' when 5 then '{"intent": "change_analysis", "concepts": ["water"'
 else '  {"concepts": ["glacier"], "requires_water": true}  ' end as response from query_log where query_id % 3 <> 1),
typed as (select query_id, case query_id % 7 when 0 then 'change_analysis' when 4 then 'temporal_search' when 1 then 'semantic_search' when 6 then 'semantic_search' end as intent,
 case query_id % 7 when 0 then 'Solar' when 1 then 'unknown thing' when 4 then 'forest' when 6 then 'glacier' end as first_concept,
 case query_id % 7 when 0 then 'Solar Farm' end as target, case query_id % 7 when 1 then 'near_road' end as rel, query_id % 7 in (0, 1, 4, 6) as valid from answers)"""


def answers(t):
    return t.spark.sql("select query_id, response from (with query_log as (" + t._sql("query_log") + "), "
                       + ANSWERS_SQL.split("typed as")[0].strip().rstrip(",").replace("chr(10)", "char(10)") + " select * from answers) z")


@query("QRY-22_parse_stored_answers", "query_log", f"with {ANSWERS_SQL} select query_id, valid, intent, first_concept, target from typed")
def _(t):
    a = answers(t).withColumn("a", tx.parse_answer(F.col("response")))
    valid = F.col("a").isNotNull()
    return a.select("query_id", valid.alias("valid"),
                    F.when(valid, F.coalesce("a.intent", F.lit("semantic_search"))).alias("intent"),
                    F.get("a.concepts", F.lit(0)).alias("first_concept"), F.col("a.target").alias("target"))


@query("QRY-23_merge_answers", "query_log", f"with {base('query_log', 'raw_query')}, {ANSWERS_SQL}" + """
select p.query_id, case when valid then case when a.intent = 'change_analysis' then 'change_search' else 'semantic_search' end else p.intent end as intent,
 case when valid and first_concept in ('Solar', 'forest', 'glacier') then lower(first_concept) else concept end as concept,
 coalesce(p.target, case when valid then replace(lower(a.target), ' ', '_') end) as target, coalesce(relationship, case when valid then rel end) as relationship, coalesce(valid, false) as llm_used
from parsed p left join typed a using (query_id)""")
def _(t):
    return queries.merge_answers(_parsed(t), answers(t)).select(
        "query_id", "intent", "concept", "target", "relationship", "llm_used")


@query("CHG-07_query_change_flags", "query_log", f"""with {intent_flags('raw_query')},
w as (select *, lower(raw_query) as low, string_split({squeeze(sub('lower(raw_query)', '''[,\\-_."']'''))}, ' ') as words from intents)
select query_id, {', '.join(f"{any_of('words', lx.CHANGE_QUERY_WORDS[k])} as asks_{k}" for k in ('construction', 'veg_loss', 'solar', 'aviation', 'road'))},
 requires_water or {any_of('words', lx.CHANGE_QUERY_WORDS['water'])} as asks_water,
 contains(low, 'first appeared') or (contains(low, 'when') and contains(low, 'appear')) or contains(low, 'estimate when') or (contains(low, 'earliest') and contains(low, 'latest')) or contains(low, 'timeline') as asks_appearance,
 {any_of('words', lx.CHANGE_QUERY_WORDS['suppression'])} or {says('low', ['high confidence', 'high-confidence', 'seasonal variation'])} as asks_suppression,
 cast(case when regexp_matches(low, '(after|post|since) 2023') then 2023 when regexp_matches(low, '(after|post|since) 2020') then 2020 end as int) as asks_since,
 len(list_filter([{', '.join(q(p) for p in lx.PLACE_WORDS)}], lambda p: list_contains(words, p))) as places from w""")
def _(t):
    flags = tx.change_query_flags(F.col("raw_query"))
    shown = {k: c for k, c in flags.items() if k != "asked_places"}
    return t.query_log.select("query_id", *[c.alias(n) for n, c in shown.items()],
                              F.size(flags["asked_places"]).cast("long").alias("places"))
