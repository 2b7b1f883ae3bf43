"""From raw records to catalogue rows, as one chain of column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.columns import clean_id
from quillon.functions.text import fold_accents, slug, title_words
from quillon.operators.hierarchy import ancestors, latest
from quillon.operators.prepare import cost_counts, current, stat
from quillon.operators.ranks import name_percent_ranks, slot_ranks
from quillon.plans.fields import RARITIES
from quillon.plans.rewrite import FLAG_TAGS, MEMBER_TAGS
from quillon.plans.skew import join_unique, left_join_unique
from quillon.runtime import drop, materialise

_NONE = "array<string>"
# Layouts and sets whose cards are extra.
EXTRA_LAYOUTS = ("token", "double_faced_token", "emblem", "planar", "scheme", "vanguard", "art_series", "front_card")
FUNNY_EXTRA_SETS = ("cmb1", "cmb2", "h17", "hho", "ph17", "ph18", "ph19", "ph20", "ph21", "ph22", "ph23", "phtr", "punk", "ulst", "unk")
#: Flags of a printing that rows keep beside the properties made of them.
FLAGS = ("booster", "digital", "full_art", "highres_image", "oversized", "promo", "reprint", "story_spotlight", "textless", "variation")
REQUIRED = ("id", "oracle_id", "name", "released_at", "type_line", "colors", "color_identity", "legalities")


def number_or_null(c: Column) -> Column:
    """A number, or text that is one; all else null."""
    return F.btrim(c.cast("string")).try_cast("double")


def whole_or_null(c: Column) -> Column:
    """The same, cut to a whole number."""
    return number_or_null(c).cast("decimal(38,6)").try_cast("bigint")


def rarity_number(c: Column) -> Column:
    """The rank of a rarity, -1 for an unknown word, null for none."""
    known = F.coalesce(*(F.when(F.lower(c) == w, F.lit(n)) for w, n in RARITIES.items()), F.lit(-1))
    return F.when(F.length(c) > 0, known)


def digits_of(c: Column) -> Column:
    """All ASCII digits of a text as one number; null if there are none or too many."""
    return F.regexp_replace(c, "[^0-9]", "").try_cast("int")


def type_words(type_line: Column) -> tuple[Column, Column]:
    """The title-cased words before and after the em dash."""
    halves = F.split(title_words(type_line), "—", 2)
    words = lambda half: F.filter(F.split(half, r"\s+"), lambda w: F.length(w) > 0)
    return words(halves[0]), F.coalesce(words(F.get(halves, F.lit(1))), F.array().cast(_NONE))


def extra_flag(r: str = "record") -> Column:
    """Whether a record is no card to play with; see the fixed values above."""
    f = lambda name: F.col(f"{r}.{name}")
    false = lambda c: F.coalesce(c, F.lit(False))
    never_legal = ~false(F.exists(F.map_values(f("legalities")), lambda v: v.isin("legal", "restricted")))
    funny = false(f("set_type") == "funny")
    lines = F.when(F.length(f("type_line")) > 0, F.array(f("type_line"))).otherwise(F.transform(f("card_faces"), lambda x: x["type_line"]))
    words = lambda line: type_words(line)[0]
    by_type = F.exists(lines, lambda t: F.arrays_overlap(words(t), F.array(F.lit("Card"), F.lit("Token"))) | (F.array_contains(words(t), F.lit("Stickers")) & ~funny))
    rules = [
        funny & false(f("set").isin(*FUNNY_EXTRA_SETS)),
        false(f("digital")) & never_legal,
        false((f("border_color") == "silver") & (f("set_type") == "promo")),
        false(f("layout").isin(*EXTRA_LAYOUTS)),
        false(f("set_type") == "memorabilia"),
        false(f("content_warning")),
        false(by_type),
        false(F.array_contains(f("promo_types"), F.lit("playtest"))) & never_legal & ~funny,
    ]
    return reduce(lambda a, b: a | b, rules)


def is_tags(r: str = "record") -> Column:
    """The properties that a record's flags and lists give it, and ``extra``."""
    flags = [F.when(F.col(f"{r}.{key}"), F.lit(tag)) for tag, key in FLAG_TAGS.items()]
    members = [F.when(F.array_contains(f"{r}.{key}", F.lit(member)), F.lit(tag)) for tag, (key, member) in MEMBER_TAGS.items()]
    return F.array_compact(F.array(*flags, *members, F.when(extra_flag(r), F.lit("extra"))))


def _join(parts: Column, separator: str) -> Column:
    return F.array_join(F.filter(parts, lambda p: F.length(p) > 0), separator)


def transform(parsed: DataFrame) -> DataFrame:
    """Catalogue rows of parsed records (``sources.jsonl.parse_records``); records without a required field are left out.

    The faces of a record are merged into one row: lists are united, texts joined, power with toughness and loyalty
    taken from the first face that has any; what a face lacks it has from the record, while a field that it has as null
    stays null.  A record whose list of faces is empty gives no row.
    """
    r = lambda name: F.col(f"record.{name}")
    df = parsed.where(reduce(lambda a, b: a & b, (r(x).isNotNull() for x in REQUIRED)))
    df = df.where(r("card_faces").isNull() | (F.size(r("card_faces")) > 0))
    faces = r("card_faces")
    several = faces.isNotNull()
    empty = F.array().cast(_NONE)

    def own(f: Column, i: Column, name: str) -> Column:
        """A field of a face, the record's own where the face does not have it."""
        return F.when(F.array_contains(F.get(F.col("face_keys"), i), name), f[name]).otherwise(r(name))

    def each(name: str) -> Column:
        """A field of every face."""
        return F.when(several, F.transform(faces, lambda f, i: own(f, i, name))).otherwise(F.array(r(name)))

    def united(name: str) -> Column:
        return F.array_distinct(F.array_compact(F.flatten(F.transform(each(name), lambda x: F.coalesce(x, empty)))))

    types = F.transform(each("type_line"), lambda t: F.struct(type_words(t)[0].alias("types"), type_words(t)[1].alias("subtypes")))
    stats = F.when(several, F.transform(faces, lambda f, i: F.struct(*(own(f, i, x).alias(x) for x in ("power", "toughness", "loyalty"))))).otherwise(F.array(F.struct(*(r(x).alias(x) for x in ("power", "toughness", "loyalty")))))
    fights = F.get(F.filter(stats, lambda s: s["power"].isNotNull() | s["toughness"].isNotNull()), F.lit(0))
    walks = F.get(F.filter(stats, lambda s: s["loyalty"].isNotNull()), F.lit(0))
    price = lambda *names: F.coalesce(*(number_or_null(F.try_element_at(r("prices"), F.lit(n))) for n in names))
    folded = lambda c: fold_accents(F.lower(c))
    faces_named = F.array_join(F.transform(faces, lambda f: F.coalesce(f["printed_name"], f["name"])), " // ")
    printed = F.when(F.exists(faces, lambda f: f["printed_name"].isNotNull()), faces_named).otherwise(r("printed_name"))
    costs = F.get(each("mana_cost"), F.lit(0))
    row = {
        "scryfall_id": clean_id(r("id")), "oracle_id": clean_id(r("oracle_id")), "illustration_id": clean_id(F.get(each("illustration_id"), F.lit(0))),
        "card_name": r("name"), "card_name_folded": folded(r("name")), "card_lang": F.lower(r("lang")), "released_at": r("released_at"),
        "card_set_code": F.lower(r("set")), "set_name": r("set_name"), "card_set_type": F.lower(r("set_type")), "collector_number": r("collector_number"), "collector_number_int": digits_of(r("collector_number")).cast("bigint"),
        "card_rarity_int": rarity_number(r("rarity")).cast("bigint"), "card_border": F.lower(r("border_color")), "card_layout": F.lower(r("layout")),
        "card_artist": r("artist"), "card_artist_folded": folded(r("artist")), "artist_ids": r("artist_ids"), "card_watermark": F.coalesce(r("watermark"), F.get(F.transform(faces, lambda f: f["watermark"]), F.lit(0))),
        "type_line": _join(each("type_line"), " // "), "card_types": F.array_distinct(F.flatten(F.transform(types, lambda t: t["types"]))), "card_subtypes": F.array_distinct(F.flatten(F.transform(types, lambda t: t["subtypes"]))),
        "oracle_text": F.nullif(_join(each("oracle_text"), "\n//\n"), F.lit("")), "flavor_text": F.coalesce(_join(each("flavor_text"), "\n//\n"), F.lit("")),
        "mana_cost_text": costs, "mana_cost_jsonb": cost_counts(costs), "cmc": number_or_null(r("cmc")),
        "creature_power_text": fights["power"], "creature_toughness_text": fights["toughness"], "creature_power": stat(fights["power"]), "creature_toughness": stat(fights["toughness"]),
        "planeswalker_loyalty_text": walks["loyalty"], "planeswalker_loyalty": whole_or_null(walks["loyalty"]),
        "card_colors": united("colors"), "card_color_identity": F.array_distinct(r("color_identity")), "produced_mana": united("produced_mana"), "color_indicator": F.array_distinct(F.coalesce(r("color_indicator"), empty)),
        "card_keywords": F.array_distinct(F.transform(united("keywords"), F.lower)), "card_keywords_printed": united("keywords"),
        "card_frame_data": F.array_distinct(F.transform(F.array_compact(F.concat(F.array(r("frame")), F.coalesce(r("frame_effects"), empty))), title_words)),
        "card_is_tags": is_tags(), "card_legalities": r("legalities"), "edhrec_rank": whole_or_null(r("edhrec_rank")),
        "price_usd": price("usd", "usd_foil", "usd_etched"), "price_eur": price("eur", "eur_foil"), "price_tix": price("tix"),
        "printed_name": r("printed_name"), "printed_name_folded": folded(printed), "printed_type_line": r("printed_type_line"), "printed_text": r("printed_text"), "flavor_name": r("flavor_name"), "flavor_name_folded": folded(r("flavor_name")),
        "card_faces": F.coalesce(faces, F.array().cast(df.schema["record"].dataType["card_faces"].dataType)),
        **{c: r(c) for c in ("frame", "set_id", "life_modifier", "hand_modifier", *FLAGS)}, "promo_types": F.coalesce(r("promo_types"), empty), "frame_effects": F.coalesce(r("frame_effects"), empty),
        **{f"price_{n}": price(n) for n in ("usd_foil", "usd_etched", "eur_foil")}, "price_usd_plain": price("usd"), "price_eur_plain": price("eur"),
        # a place for every face, null where its picture is unknown
        "face_illustrations": F.when(several, F.transform(each("illustration_id"), clean_id)).otherwise(F.array(clean_id(r("illustration_id")))),
        "finishes": F.coalesce(r("finishes"), empty), "games": F.coalesce(r("games"), empty), "image_status": r("image_status"), "multiverse_ids": r("multiverse_ids"),
        "external_ids": F.map_filter(F.create_map(*(x for k in ("arena_id", "mtgo_id", "tcgplayer_id", "cardmarket_id") for x in (F.lit(k), whole_or_null(r(k))))), lambda _, v: v.isNotNull()),
        "residue": F.col("residue"), "is_canonical": F.lit(True),
    }
    kept = [c for c in df.columns if c not in ("record", "residue", "face_keys", *row)]
    # short expressions first: the planner rewrites what it knows of the columns so far by each that follows and is part of
    # them, so a flag that came after the properties made of ten flags would leave a thousand forms of these
    return df.select(*kept, *(v.alias(k) for k, v in sorted(row.items(), key=lambda x: len(str(x[1])))))


def tag_reach(tags: DataFrame, version: tuple[str, ...] = ("updated_at", "row_no"), kept: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, taggings) of the tags, and (id, slug) of each with its own and all broader slugs; both kept as tables, whose
    paths ``kept`` gets."""
    newest = latest(tags.select("id", F.struct("slug", "parent_ids", "taggings").alias("row"), *version), "id", "row", list(version))
    named, path = materialise(newest.select("id", slug(F.col("parents.slug")).alias("slug"), F.col("parents.taggings").alias("taggings")).where("slug <> ''"), "tags")
    up = ancestors(tags, "id", "parent_ids", list(version)).where("id <> ancestor_id").select("id", "ancestor_id")
    own = named.select("id", F.col("id").alias("ancestor_id"))
    reach, wider = materialise(own.unionByName(up).join(named.select(F.col("id").alias("ancestor_id"), "slug"), "ancestor_id").select("id", "slug"), "reach")
    if kept is not None:
        kept += [path, wider]
    return named.select("id", "taggings"), reach


def tag_lists(tagged: DataFrame, reach: DataFrame, of: str) -> DataFrame:
    """(``of``, tags): the sorted slugs that each ``oracle_id`` or ``illustration_id`` is tagged with, broader tags included."""
    of_tag = tagged.select("id", F.explode("taggings").alias("t")).select("id", clean_id(F.col(f"t.{of}")).alias(of)).where(F.col(of).isNotNull()).distinct()
    return of_tag.join(reach, "id").groupBy(of).agg(F.array_sort(F.collect_set("slug")).alias("tags"))


def tag_aliases(tags: DataFrame, version: tuple[str, ...] = ("updated_at", "row_no")) -> DataFrame:
    """(alias, slug): what other names of tags stand for; names that are slugs themselves or are claimed by more than one
    tag stand for nothing."""
    newest = latest(tags.select("id", F.struct("slug", "aliases").alias("row"), *version), "id", "row", list(version))
    named = newest.select(slug(F.col("parents.slug")).alias("slug"), F.col("parents.aliases").alias("aliases")).where("slug <> ''")
    claims = named.select("slug", F.explode("aliases").alias("alias")).select("slug", slug(F.col("alias")).alias("alias")).where("alias <> ''")
    free = claims.join(named.select(F.col("slug").alias("alias")), "alias", "left_anti")
    return free.groupBy("alias").agg(F.min("slug").alias("slug"), F.count_distinct("slug").alias("n")).where("n = 1").select("alias", "slug")


def illustrations(faces: Column, own: Column) -> Column:
    """The illustration ids of a row, its own first."""
    return F.filter(F.array_distinct(F.concat(F.array(own), F.coalesce(F.transform(faces, lambda f: clean_id(f["illustration_id"])), F.array().cast(_NONE)))), lambda i: i.isNotNull())


def off_style(art_tags: Column) -> Column:
    """Whether art tags say that a picture leaves the game's own world or manner."""
    has = lambda t: F.coalesce(F.array_contains(art_tags, F.lit(t)), F.lit(False))
    return (has("external-ip") & ~(has("dungeons-and-dragons") | has("the-lord-of-the-rings"))) | has("anime") | has("comic-style") | has("line-art") | has("word-art-title")


def components_score() -> Column:
    """The part of a printing's preference that it has by itself."""
    # The weights.
    has = lambda c, v: F.coalesce(F.array_contains(c, F.lit(v)), F.lit(False))
    w = lambda cond, value, other=0.0: F.when(F.coalesce(cond, F.lit(False)), float(value)).otherwise(other)
    frame = F.when(has("card_frame_data", "2015"), 42.0).when(has("card_frame_data", "2003"), 30.0).when(has("card_frame_data", "1997"), 25.0).when(has("card_frame_data", "1993"), 10.0).otherwise(0.0)
    parts = [
        F.round(F.lit(23.0) * F.ln(1 + F.col("illustration_count")) / F.ln(F.lit(40.0)), 4),
        F.when(F.col("card_rarity_int").isin(0, 1), 16.0).when(F.col("card_rarity_int") == 2, 11.0).otherwise(0.0),
        w(F.col("card_border") == "black", 14),
        frame,
        w(has("card_frame_data", "Extendedart"), -6),
        w(F.col("image_status") == "highres_scan", 16),
        w(has("games", "paper"), 6),
        w(F.col("card_lang") == "en", 40),
        w(has("card_frame_data", "Legendary"), 5),
        w(has("card_frame_data", "Showcase"), 0, 10.0),
        F.when(has("finishes", "nonfoil"), 10.0).when(has("finishes", "foil"), 5.0).otherwise(0.0),
        w(F.col("card_set_code") == "dbl", 0, 20.0),
        w(off_style(F.col("card_art_tags")), 0, 14.0),
    ]
    return reduce(lambda a, b: a + b, parts)


def pinned_slots(rows: DataFrame, labels: DataFrame, key: str = "scryfall_id") -> DataFrame:
    """(oracle_id, card_set_code, collector_number): the slots of the printings whose ids ``labels`` (id) names as those that
    stand for their cards; for ``finalize``."""
    named = labels.select(clean_id("id").alias(key)).where(F.col(key).isNotNull()).distinct()
    return rows.join(named, key, "left_semi").select("oracle_id", "card_set_code", "collector_number").distinct()


def finalize(rows: DataFrame, tags: DataFrame | None = None, pinned: DataFrame | None = None, version: tuple[str, ...] = ("line_no",), kept: list[str] | None = None) -> DataFrame:
    """Catalogue rows with what only the whole catalogue can tell: tags, counts of artworks, ranks and scores.

    Rows that repeat an id count as the one of greatest ``version`` columns.  ``pinned`` (oracle_id, card_set_code,
    collector_number) names the slots that go first.  A card or artwork that holds a third of all rows is spread over
    all tasks in every join.  ``kept`` gets the paths of the tables that the result reads.
    """
    empty = F.array().cast(_NONE)
    once, path = materialise(current(rows, list(version)).withColumn("_ills", illustrations(F.col("card_faces"), F.col("illustration_id"))), "once")
    size = once.count()
    facts, paths = [], [path]

    def keep(fact: DataFrame) -> None:
        fact, path = materialise(fact, "facts")
        facts.append(fact)
        paths.append(path)

    def add(right: DataFrame, keys: list[str]) -> None:
        """Keeps the columns of ``right`` by printing.  A skew-proof join reads its left side four times, so joins on top of
        each other would read the rows, and plan them, four times as often with each; only narrow rows take part."""
        keep(left_join_unique(once.select("scryfall_id", *keys), right, keys, size).drop(*keys))

    if tags is not None:
        reached = tag_reach(tags, kept=(spent := []))
        add(tag_lists(*reached, "oracle_id").withColumnRenamed("tags", "card_oracle_tags"), ["oracle_id"])
        art = tag_lists(*reached, "illustration_id")
        of_rows = join_unique(once.select("scryfall_id", F.explode("_ills").alias("illustration_id")), art, "illustration_id", size).groupBy("scryfall_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("card_art_tags"))
        keep(of_rows)
        for path in spent:
            drop(once.sparkSession, path)
    regular = (F.col("card_lang") == "en") & (F.coalesce("card_set_type", F.lit("")) != "memorabilia") & ~F.coalesce("card_border", F.lit("")).isin("gold", "yellow") & F.col("illustration_id").isNotNull()
    add(once.where(regular).groupBy("illustration_id", "card_name").agg(F.count("*").alias("illustration_count")), ["illustration_id", "card_name"])
    add(name_percent_ranks(once, "card_name", "edhrec_rank", version[0]).withColumnRenamed("score", "_pr"), ["card_name"])
    slots = once.select("oracle_id", F.col("card_set_code").alias("set_code"), "collector_number", F.col("released_at").try_cast("date").alias("released"), F.col("card_lang").alias("lang"))
    pins = None if pinned is None else pinned.select("oracle_id", F.col("card_set_code").alias("set_code"), "collector_number")
    ranked = slot_ranks(slots, pins).select("oracle_id", F.col("set_code").alias("card_set_code"), "collector_number", "rank", *([] if pins is None else ["pinned"]))
    add(ranked, ["oracle_id", "card_set_code", "collector_number"])
    if kept is not None:
        kept += paths
    df = reduce(lambda rows, fact: rows.join(fact, "scryfall_id", "left"), facts, once)
    given = (lambda c: F.coalesce(c, empty)) if tags is not None else lambda c: empty
    df = df.withColumns({c: given(c) for c in ("card_oracle_tags", "card_art_tags")})
    df = df.withColumn("illustration_count", F.coalesce("illustration_count", F.lit(0))).withColumn("cubecobra_score", F.col("_pr").cast("float")).drop("_pr")
    bonus = F.lit(0.0) if pins is None else F.when(F.col("pinned"), 1000.0).otherwise(0.0)
    rank = F.least(F.coalesce("rank", F.lit(1024)), F.lit(1024))
    score = (F.lit(1024) - rank) * 2048 + components_score() + bonus
    return df.withColumn("prefer_score", score.cast("float")).drop("_ills", "rank", "pinned")
