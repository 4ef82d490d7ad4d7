"""Query-text expressions: cleaning, lemmas, places, dates, intent.

Regular expressions run with Unicode word classes ((?U)), so accented letters
are letters. Everything here is a column expression; nothing shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from swathe import lexicon as lx


def word_set(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def has_any(tokens: Column, words) -> Column:
    return F.arrays_overlap(tokens, word_set(words))


def contains_any(text: Column, phrases) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | text.contains(phrase)
    return found


def squeeze(text: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def tokens_of(text: Column) -> Column:
    """Words of a text; an empty text has none."""
    return F.filter(F.split(squeeze(text), " "), lambda w: w != "")


# -- normalisation ----------------------------------------------------------

def cleanup(text: Column) -> Column:
    return squeeze(F.lower(F.coalesce(text, F.lit(""))))


def normalize_punctuation(text: Column) -> Column:
    """Punctuation to blanks; hyphens and dots between digits stay."""
    text = F.regexp_replace(text, r"""[\[\](){}"'/\\&,;:!?*~#^+=<>|]""", " ")
    text = F.regexp_replace(text, r"(?U)(?<!\d)\.|\.(?!\d)", " ")
    return squeeze(text)


def synonym_rules(synonyms: dict[str, str] = lx.SYNONYMS) -> list[tuple[str, str]]:
    """Longest phrase first; a later rule sees what earlier rules wrote."""
    return sorted(synonyms.items(), key=lambda rule: -len(rule[0]))


def apply_synonyms(text: Column, synonyms: dict[str, str] = lx.SYNONYMS) -> Column:
    for phrase, term in synonym_rules(synonyms):
        text = F.regexp_replace(text, rf"(?U)\b\Q{phrase}\E\b", term)
    return text


def lemma(word: Column) -> Column:
    known = F.create_map(*[
        F.lit(x) for pair in {**lx.DOMAIN_LEMMAS, **lx.PLURAL_EXCEPTIONS}.items() for x in pair])
    size = F.length(word)
    cut = lambda n: F.substring(word, F.lit(1), size - n)
    sibilant = word.rlike("(sh|ch|x|z)es$")
    return F.coalesce(
        F.element_at(known, word),
        F.when(word.endswith("ies") & (size > 4), F.concat(cut(3), F.lit("y")))
        .when(sibilant & (size > 4), cut(2))
        .when(word.endswith("s") & ~word.endswith("ss") & (size > 3), cut(1))
        .otherwise(word),
    )


def lemmatize(text: Column) -> Column:
    return F.array_join(F.transform(tokens_of(text), lemma), " ")


def normalize(text: Column) -> Column:
    return lemmatize(apply_synonyms(normalize_punctuation(cleanup(text))))


# -- places -------------------------------------------------------------------

def place_rules(places=lx.PLACES, fallback=lx.FALLBACK_BOXES) -> list[dict]:
    """Places in matching order, each with one pattern for all its names.

    Longer canonical names go first. All names of a place stand together in
    the order, so the first place with any hit is the first hit.
    """
    rules = []
    for name, aliases, kind, box in sorted(places, key=lambda p: -len(p[0])):
        rules.append({"name": name, "kind": kind, "box": box, "names": [name] + aliases})
    known = {n.lower() for rule in rules for n in rule["names"]}
    for name, box in sorted(fallback.items(), key=lambda p: -len(p[0])):
        if name in known:
            continue  # the gazetteer answers first
        kind = "state" if name in lx.FALLBACK_STATES else "city"
        rules.append({"name": name.title(), "kind": kind, "box": box, "names": [name]})
    for rule in rules:
        names = sorted(rule["names"], key=lambda n: -len(n))
        rule["any_name"] = "|".join(rf"\Q{n.lower()}\E" for n in names)
    return rules


def resolve_place(text: Column, places=lx.PLACES, fallback=lx.FALLBACK_BOXES) -> Column:
    """struct<name, kind, west, south, east, north, any_name> of the first place named, or NULL."""
    text = F.lower(text)
    rules = place_rules(places, fallback)
    number = F.when(F.lit(False), F.lit(0))
    for i, rule in enumerate(rules, start=1):
        number = number.when(text.rlike(rf"(?U)\b(?:{rule['any_name']})\b"), F.lit(i))
    table = F.array(*[
        F.struct(
            F.lit(rule["name"]).alias("name"), F.lit(rule["kind"]).alias("kind"),
            *[F.lit(float(v)).alias(k)
              for k, v in zip(("west", "south", "east", "north"), rule["box"])],
            F.lit(rule["any_name"]).alias("any_name"))
        for rule in rules])
    return F.when(number.isNotNull(), F.element_at(table, number))


def strip_place(text: Column, place: Column) -> Column:
    """Remove every name of a resolved place, with a preposition before it."""
    preposition = r"(?:\b(?:in|at|within|inside|around|near|across|along|through|of)\s+)?"
    pattern = F.concat(F.lit(r"(?iU)" + preposition + r"\b(?:"), place["any_name"], F.lit(r")\b"))
    return F.when(place.isNull(), squeeze(text)).otherwise(
        squeeze(F.regexp_replace(text, pattern, F.lit(" "))))


# -- dates, quality, sensors ----------------------------------------------------

def _year(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, "(?U)" + pattern, group), F.lit("")).cast("int")


def temporal_bounds(text: Column) -> dict[str, Column]:
    """start_date, end_date, time_anchor. A named year counts in full at either end."""
    text = F.lower(text)
    between = r"\bbetween\s+(\d{4})\s+(?:and|to)\s+(\d{4})\b"
    first, last = _year(text, between, 1), _year(text, between, 2)
    after = _year(text, r"\b(?:after|since|from|post)\s+(\d{4})\b")
    before = _year(text, r"\b(?:before|prior to|until|up to)\s+(\d{4})\b")
    inside = _year(text, r"\bin\s+(\d{4})\b")
    inside = F.when(after.isNull() & before.isNull(), inside)
    start = F.coalesce(first, F.when(first.isNull(), F.coalesce(after, inside)))
    end = F.coalesce(last, F.when(first.isNull(), F.coalesce(before, inside)))
    anchor = F.coalesce(
        F.concat_ws("-", F.when(first.isNotNull(), first.cast("string")), last.cast("string")),
        F.lit(""))
    anchor = F.when(first.isNotNull(), anchor).otherwise(
        F.coalesce(after, before, inside).cast("string"))
    one = F.lit(1)
    return {
        "start_date": F.try_make_timestamp(start, one, one, F.lit(0), F.lit(0), F.lit(0)),
        "end_date": F.try_make_timestamp(end, F.lit(12), F.lit(31), F.lit(23), F.lit(59), F.lit(59)),
        "time_anchor": anchor,
    }


def quality_hints(text: Column) -> dict[str, Column]:
    text = F.lower(text)
    cloud = F.when(contains_any(text, lx.CLOUDLESS_PHRASES), 5.0).when(
        text.contains("low cloud"), 15.0)
    quality = F.when(contains_any(text, ["high quality", "crisp", "clear"]), 0.75)
    sensors = F.array_compact(F.array(
        F.when(text.contains("sentinel"), "Sentinel-2"),
        F.when(contains_any(text, ["landsat-8", "landsat 8"]), "Landsat-8")
        .when(text.contains("landsat"), "Landsat"),
        F.when(text.contains("planet"), "PlanetScope"),
    ))
    return {
        "max_cloud_cover": cloud,
        "min_quality": quality,
        "sensors": F.when(F.size(sensors) > 0, sensors),
    }


# -- intent ------------------------------------------------------------------

def relationship(text: Column) -> Column:
    text = F.lower(text)
    chain = F
    for name, pattern in lx.RELATIONS:
        chain = chain.when(text.rlike("(?U)" + pattern), name)
    return chain.otherwise(F.lit(None).cast("string"))


def is_change_query(tokens: Column, anchor: Column, relation: Column) -> Column:
    has = lambda *words: has_any(tokens, words)
    return (
        has_any(tokens, lx.CHANGE_WORDS)
        | (has("between") & has("and", "to"))
        | has("since")
        | (has("after") & anchor.isNotNull())
        | (relation.isNotNull() & has_any(tokens, lx.RELATED_CHANGE_WORDS))
    )


def intent(tokens: Column, anchor: Column, relation: Column) -> Column:
    return F.when(is_change_query(tokens, anchor, relation), "change_search").otherwise(
        "semantic_search")


# Which words name which target or concept; the first row that hits decides.
TARGET_RULES = [
    (["demolition", "demolished"], "demolition"),
    (["vegetation_clearance", "clearance", "deforestation"], "vegetation_clearance"),
    (["expansion", "development"], {
        "urban": "urban_expansion", "airport": "airport_expansion", "runway": "airport_expansion",
        "solar": "solar_development", "road": "road_expansion", None: "urban_expansion"}),
    (["construction", "building"], "construction"),
    (["water", "reservoir", "lake", "river"], "water"),
    (["road", "highway"], "road"),
]
CONCEPT_RULES = [
    (["desert", "dune"], "desert"),
    (["airport", "runway", "terminal"], "airport"),
    (["solar"], "solar"),
    (["farmland", "crop", "agriculture"], "farmland"),
    (["forest"], "forest"),
    (["reservoir"], "reservoir"),
    (["lake"], "lake"),
    (["river"], "river"),
    (["port", "harbor"], "port"),
    (["mountain", "glacier"], "mountain"),
    (["residential"], "residential"),
    (["industrial"], "industrial"),
    (["urban"], "urban"),
    (["road", "highway"], "road"),
    (["water"], "water"),
    (["construction"], "construction"),
]


def target_concept(tokens: Column, is_change: Column) -> tuple[Column, Column]:
    target = F.when(F.lit(False), F.lit(""))
    for words, outcome in TARGET_RULES:
        if isinstance(outcome, dict):
            inner = F.when(F.lit(False), F.lit(""))
            for word, name in outcome.items():
                inner = inner.otherwise(name) if word is None else inner.when(
                    has_any(tokens, [word]), name)
            outcome = inner
        target = target.when(has_any(tokens, words), outcome)
    concept = F.when(F.lit(False), F.lit(""))
    for words, name in CONCEPT_RULES:
        concept = concept.when(has_any(tokens, words), name)
    return (
        F.when(is_change, F.coalesce(target, concept)).otherwise(target),
        F.when(is_change, concept).otherwise(F.coalesce(concept, target)),
    )


def landcover_needs(tokens: Column, relation: Column) -> dict[str, Column]:
    near = lambda *names: F.coalesce(relation.isin(*names), F.lit(False))
    return {
        "requires_water": has_any(tokens, lx.NEEDS_WATER) | near("near_water"),
        "requires_vegetation": has_any(tokens, lx.NEEDS_VEGETATION),
        "requires_urban": has_any(tokens, lx.NEEDS_URBAN) | near("near_road", "near_urban"),
    }


def canonical_text(normalized: Column, concept, target, relation, place_name) -> Column:
    """What is left to embed once dates, sensors and the place name are gone."""
    text = normalized
    for noise in (
        r"\b(after|since|before|between|from|until|in|to|and|post)\s+\d{4}\b",
        r"\b\d{4}\b",
        r"\b(cloud-free|cloudless|no clouds|clear sky|sentinel-2|sentinel|landsat-8|landsat)\b",
    ):
        text = F.regexp_replace(text, "(?U)" + noise, "")
    text = squeeze(text)
    name = F.concat(F.lit(r"\Q"), F.lower(place_name), F.lit(r"\E\b"))
    bare = F.regexp_replace(
        text,
        F.concat(F.lit(r"(?U)\b(in|at|within|inside|near|around|across|along|of)\s+"), name),
        F.lit(" "))
    bare = F.regexp_replace(bare, F.concat(F.lit(r"(?U)\b"), name), F.lit(" "))
    bare = F.regexp_replace(bare, r"(?U)\b(in|at|within|of|near|around)\s*$", "")
    bare = F.regexp_replace(bare, r"(?U)^\s*(in|at|within|of|near|around)\b", "")
    text = F.when(place_name.isNull(), text).otherwise(squeeze(bare))
    text = (
        F.when((relation == "near_road") & ~text.contains("road"),
               F.concat(text, F.lit(" road infrastructure")))
        .when((relation == "near_water") & ~text.contains("water"),
              F.concat(text, F.lit(" water surface")))
        .otherwise(text)
    )
    spare = F.concat_ws(" ", concept, target)
    spare = F.when(spare == "", normalized).otherwise(spare)
    return F.trim(F.when(text == "", spare).otherwise(text))


# -- land-cover intent of a raw query ---------------------------------------------

def spectral_intent(query: Column) -> dict[str, Column]:
    """Twelve flags (eleven booleans and a count) read from the raw query text."""
    lower = F.lower(query)
    words = tokens_of(F.regexp_replace(lower, r"[&/,.\-]", " "))
    named = {kind: has_any(words, vocabulary) for kind, vocabulary in lx.INTENT_WORDS.items()}
    said = {kind: contains_any(lower, phrases) for kind, phrases in lx.INTENT_PHRASES.items()}
    water = named["water"] | said["water"]
    vegetation = named["vegetation"] | said["vegetation"]
    solar = named["solar"] | said["solar"]
    aviation, site = named["aviation"], named["construction_site"]
    built = named["industrial"] | named["residential"] | named["road"]
    urban = (named["urban"] | built | site | said["urban"]) & ~(aviation | solar)
    pure_water = water & ~(urban | vegetation | aviation | solar | site)
    count = (water.cast("int") + vegetation.cast("int") + (urban | built).cast("int"))
    return {
        "requires_water": water, "requires_vegetation": vegetation, "requires_urban": urban,
        "pure_water": pure_water, "is_aviation": aviation, "is_solar": solar,
        "is_mountain": named["mountain"], "is_industrial": named["industrial"],
        "is_residential": named["residential"], "is_road": named["road"],
        "is_construction_site": site, "composite_count": count,
    }


def spectral_intent_struct(query: Column) -> Column:
    return F.struct(*[c.alias(name) for name, c in spectral_intent(query).items()])


# -- change queries --------------------------------------------------------------

def change_query_words(query: Column) -> Column:
    return tokens_of(F.regexp_replace(F.lower(query), r"""[,\-_."']""", " "))


def change_query_flags(query: Column, needs_water: Column | None = None) -> dict[str, Column]:
    """What kind of change a query asks for; ``needs_water`` comes from its land-cover intent."""
    lower = F.lower(query)
    words = change_query_words(query)
    asks = {kind: has_any(words, vocabulary) for kind, vocabulary in lx.CHANGE_QUERY_WORDS.items()}
    has = lower.contains
    appearance = (
        has("first appeared") | (has("when") & has("appear")) | has("estimate when")
        | (has("earliest") & has("latest")) | has("timeline")
    )
    quiet = asks["suppression"] | contains_any(
        lower, ["high confidence", "high-confidence", "seasonal variation"])
    since = lambda year: contains_any(lower, [f"{w} {year}" for w in ("after", "post", "since")])
    if needs_water is None:
        needs_water = spectral_intent(query)["requires_water"]
    return {
        "asks_construction": asks["construction"], "asks_veg_loss": asks["veg_loss"],
        "asks_solar": asks["solar"], "asks_aviation": asks["aviation"], "asks_road": asks["road"],
        "asks_appearance": appearance, "asks_suppression": quiet,
        "asks_water": needs_water | asks["water"],
        "asks_since": F.when(since(2023), 2023).when(since(2020), 2020),
        "asked_places": F.array_intersect(words, word_set(lx.PLACE_WORDS)),
    }


def path_tokens(path: Column) -> Column:
    return tokens_of(F.regexp_replace(F.lower(path), r"[_\-\\/.]", " "))


def site_flags(tokens: Column, water_before: Column, water_after: Column) -> dict[str, Column]:
    on = {kind: has_any(tokens, words) for kind, words in lx.SITE_WORDS.items()}
    return {
        "solar_site": on["solar"], "airport_site": on["airport"], "road_site": on["road"],
        "water_site": on["water"] | (water_before >= 10.0) | (water_after >= 10.0),
    }


# -- stored model answers ------------------------------------------------------------

# The fields of a structured answer.
ANSWER_SCHEMA = (
    "intent string, location string, location_type string, concepts array<string>, target string, "
    "change_type string, relationships array<string>, start_date string, end_date string, "
    "sensor string, confidence_requirement string, requires_water boolean, "
    "requires_vegetation boolean, requires_urban boolean, raw_query string, corrected_query string"
)
ANSWER_INTENTS = ["change_analysis", "semantic_search", "temporal_search", "general_query"]


def strip_code_fences(text: Column) -> Column:
    text = F.regexp_replace(F.btrim(text, F.lit(" \t\r\n")), r"(?i)^```(?:json)?\s*\n?", "")
    text = F.regexp_replace(F.btrim(text, F.lit(" \t\r\n")), r"\n?```\s*$", "")
    return F.btrim(text, F.lit(" \t\r\n"))


def parse_answer(text: Column) -> Column:
    """Typed struct of a stored answer; NULL when it is not a valid one."""
    body = strip_code_fences(text)
    parsed = F.from_json(
        body, ANSWER_SCHEMA + ", broken string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    intent_ok = F.coalesce(parsed["intent"], F.lit("semantic_search")).isin(ANSWER_INTENTS)
    return F.when(body.startswith("{") & parsed["broken"].isNull() & intent_ok, parsed)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), " ", "_")


