"""The table that queries run on: catalogue rows with the columns that predicates and orders need.

Whatever a predicate would have to compute per row and query, such as folded names or colours as bits, is computed here
once, so that every leaf of a query is a plain comparison that Catalyst can push and fuse.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.columns import clean_id
from quillon.functions.text import collate, natural_key
from quillon.plans.compile import GENERIC
from quillon.plans.fields import COLORS
from quillon.plans.skew import left_join_unique
from quillon.runtime import materialise

_STRINGS, _COUNTS = "array<string>", "map<string,int>"
#: Columns of a catalogue row that queries can use, with their types; those a table lacks are taken as null.
ROW = {
    "scryfall_id": "string", "oracle_id": "string", "illustration_id": "string", "card_name": "string", "card_lang": "string",
    "released_at": "string", "card_set_code": "string", "set_name": "string", "card_set_type": "string", "collector_number": "string",
    "collector_number_int": "bigint", "card_rarity_int": "bigint", "card_border": "string", "card_layout": "string", "card_artist": "string",
    "card_watermark": "string", "type_line": "string", "oracle_text": "string", "flavor_text": "string", "mana_cost_text": "string",
    "cmc": "double", "creature_power": "double", "creature_toughness": "double", "planeswalker_loyalty": "bigint",
    "card_colors": _STRINGS, "card_color_identity": _STRINGS, "produced_mana": _STRINGS, "card_keywords": _STRINGS, "card_frame_data": _STRINGS,
    "card_oracle_tags": _STRINGS, "card_art_tags": _STRINGS, "card_is_tags": _STRINGS, "card_legalities": "map<string,string>",
    "edhrec_rank": "bigint", "cubecobra_score": "float", "price_usd": "double", "price_eur": "double", "price_tix": "double",
    "prefer_score": "float", "is_canonical": "boolean", "printed_name": "string", "flavor_name": "string",
}
#: Further columns that results show and predicates do not read.
SHOWN = {
    "printed_type_line": "string", "printed_text": "string", "creature_power_text": "string", "creature_toughness_text": "string", "planeswalker_loyalty_text": "string", "life_modifier": "string", "hand_modifier": "string",
    "frame": "string", "image_status": "string", "set_id": "string", "price_usd_foil": "double", "price_usd_etched": "double", "price_eur_foil": "double",
    "booster": "boolean", "digital": "boolean", "full_art": "boolean", "highres_image": "boolean", "oversized": "boolean", "promo": "boolean", "reprint": "boolean", "story_spotlight": "boolean", "textless": "boolean", "variation": "boolean",
    "finishes": _STRINGS, "games": _STRINGS, "promo_types": _STRINGS, "frame_effects": _STRINGS, "color_indicator": _STRINGS, "card_keywords_printed": _STRINGS, "multiverse_ids": "array<bigint>",
    "external_ids": "map<string,bigint>", "residue": "map<string,string>",
}
#: Fields of a face that predicates look at.
FACE = {"name": "string", "type_line": "string", "mana_cost": "string", "oracle_text": "string", "printed_name": "string", "colors": _STRINGS, "power": "string", "toughness": "string", "loyalty": "string", "layout": "string", "watermark": "string", "illustration_id": "string",
        "defense": "string", "color_indicator": _STRINGS, "flavor_text": "string", "artist": "string", "artist_id": "string", "printed_type_line": "string", "printed_text": "string", "flavor_name": "string"}


def mask(colors: Column) -> Column:
    """Colour letters as bits, W lowest, C a bit of its own; null counts as none."""
    one = lambda i, c: F.when(F.array_contains(colors, F.lit(c)), F.lit(1 << i)).otherwise(0)
    return F.coalesce(reduce(lambda a, b: a.bitwiseOR(b), (one(i, c) for i, c in enumerate(COLORS.upper() + "C"))), F.lit(0))


def symbols(cost: Column) -> Column:
    """The symbols of a mana cost in order: what stands in braces, and bare letters."""
    return F.regexp_extract_all(F.upper(cost), F.lit(r"(\{[^}]*\}|[WUBRGCX])"), 1)


def cost_counts(cost: Column) -> Column:
    """A cost as symbol -> count, generic mana under one key; null for no cost."""
    bare = F.transform(symbols(cost), lambda s: F.btrim(s, F.lit("{} ")))
    generic = F.aggregate(F.filter(bare, lambda s: F.rlike(s, F.lit("^[0-9]{1,9}$"))), F.lit(0), lambda a, s: a + s.cast("int"))
    others = F.filter(bare, lambda s: ~F.rlike(s, F.lit("^[0-9]*$")))
    entries = F.transform(F.array_distinct(others), lambda s: F.struct(s.alias("k"), F.size(F.filter(others, lambda t: t == s)).alias("n")))
    rest = F.when(generic > 0, F.array(F.struct(F.lit(GENERIC).alias("k"), generic.alias("n")))).otherwise(F.array().cast("array<struct<k:string,n:int>>"))
    return F.when(F.length(cost) > 0, F.map_from_entries(F.concat(entries, rest)))


def stat(text: Column) -> Column:
    """A power, toughness or loyalty as a number: sums of numbers, with ``*``, ``?`` and squares as 0; endless as null."""
    text = F.regexp_replace(F.btrim(text), r"[*?](²)?", "0")
    terms = F.regexp_extract_all(text, F.lit(r"([+-]?[0-9]*\.?[0-9]+)"), 1)
    total = F.aggregate(terms, F.lit(0.0), lambda a, t: a + F.coalesce(t.try_cast("double"), F.lit(0.0)))
    return F.when(F.rlike(text, F.lit(r"^[+-]?[0-9]*\.?[0-9]+([+-][0-9]*\.?[0-9]+)*$")), total)


def _face_fields(df: DataFrame) -> set[str]:
    kind = df.schema["card_faces"].dataType if "card_faces" in df.columns else None
    return {f.name for f in kind.elementType.fields} if isinstance(kind, T.ArrayType) else set()


def _faces(df: DataFrame) -> Column:
    """The faces with the fields of ``FACE``, null where absent."""
    have = _face_fields(df)
    if not have:
        return F.array().cast("array<struct<" + ",".join(f"{k}:{v}" for k, v in FACE.items()) + ">>")
    pick = lambda f: F.struct(*((f[k] if k in have else F.lit(None)).cast(v).alias(k) for k, v in FACE.items()))
    return F.coalesce(F.transform(F.col("card_faces"), pick), F.array().cast("array<struct<" + ",".join(f"{k}:{v}" for k, v in FACE.items()) + ">>"))


def current(df: DataFrame, version: list[str], removed: str | None = None) -> DataFrame:
    """One row per printing: its row of greatest ``version`` columns, unless ``removed`` is set in it.

    Rows without a printing's id are left out; nulls in ``version`` are least.
    """
    keyed = df.withColumn("scryfall_id", clean_id("scryfall_id")).where("scryfall_id is not null")
    newest = Window.partitionBy("scryfall_id").orderBy(*(F.col(c).desc_nulls_last() for c in version))
    out = keyed.withColumn("_newest", F.row_number().over(newest)).where("_newest = 1").drop("_newest")
    return out.where(F.col(removed).isNull()) if removed else out


def prepare(rows: DataFrame) -> DataFrame:
    """Catalogue rows with search columns; see ``plans.fields`` for who reads which.

    Missing columns count as null.  Columns of ``rows`` that are no catalogue columns are kept unless a search column
    has their name.
    """
    df = rows.withColumns({c: F.lit(None).cast(t) for c, t in {**ROW, **SHOWN}.items() if c not in rows.columns})
    # the price that filters and orders read may be that of another finish; a table with one price has no other
    df = df.withColumns({f"{c}_plain": F.col(c) for c in ("price_usd", "price_eur") if f"{c}_plain" not in rows.columns})
    # two projections: the second reads what the first has computed
    df = df.withColumns({"oracle_id": clean_id("oracle_id"), "illustration_id": clean_id("illustration_id"), "faces": _faces(df), "is_canonical": F.coalesce("is_canonical", F.lit(True))})
    f, lower = F.col("faces"), lambda c: F.lower(F.col(c))
    listed = lambda c: F.coalesce(F.transform(F.col(c), F.lower), F.array().cast(_STRINGS))
    of_faces = lambda key, own: F.array_distinct(F.array_compact(F.concat(F.array(own), F.transform(f, lambda x: x[key]))))
    numbers = lambda key, own: F.array_distinct(F.array_compact(F.concat(F.array(F.col(own).cast("double")), F.transform(f, lambda x: stat(x[key])))))
    costs = F.array_compact(F.when(F.exists(f, lambda x: F.length(x["mana_cost"]) > 0), F.transform(f, lambda x: cost_counts(x["mana_cost"]))).otherwise(F.array(cost_counts(F.col("mana_cost_text")))))
    permanent = F.rlike(lower("type_line"), F.lit("creature|artifact|enchantment|land|planeswalker|battle"))
    text = F.col("oracle_text")
    # no text is a text of its own where a table has texts; faces without the field have the row's
    front_text = F.coalesce(text, F.lit("")) if "oracle_text" in rows.columns else text
    if "oracle_text" in _face_fields(rows):
        front_text = F.when(F.size(f) > 0, F.coalesce(F.get(f, F.lit(0))["oracle_text"], F.lit(""))).otherwise(front_text)
    search = {
        "name_lower": lower("card_name"),
        "name_collated": collate(F.col("card_name")),
        "printed_collated": collate(F.col("printed_name")),
        "flavor_collated": collate(F.col("flavor_name")),
        "face_names_collated": F.transform(f, lambda x: collate(x["name"])),
        "artist_collated": collate(F.col("card_artist")),
        "type_line_lower": F.lower(F.when(F.size(f) > 0, F.coalesce(F.col("type_line"), F.array_join(F.transform(f, lambda x: x["type_line"]), " // "))).otherwise(F.col("type_line"))),
        "oracle_text_lower": F.lower(text),
        "oracle_text_bare": F.lower(F.regexp_replace(text, r"\([^)]*\)", "")),
        # the front face alone decides whether a card has no text
        "front_text_bare": F.regexp_replace(front_text, r"\([^)]*\)", ""),
        "flavor_text_lower": lower("flavor_text"),
        "mana_cost_joined": F.when(F.size(f) > 0, F.array_join(F.filter(F.transform(f, lambda x: x["mana_cost"]), lambda c: F.length(c) > 0), " // ")).otherwise(F.col("mana_cost_text")),
        "face_color_masks": F.when(F.exists(f, lambda x: x["colors"].isNotNull()), F.transform(f, lambda x: mask(F.coalesce(x["colors"], F.col("card_colors"))).bitwiseAND(F.lit(31)))).otherwise(F.array(mask(F.col("card_colors")).bitwiseAND(F.lit(31)))),
        "color_mask": mask(F.col("card_colors")).bitwiseAND(F.lit(31)),
        "identity_mask": mask(F.col("card_color_identity")).bitwiseAND(F.lit(31)),
        "produced_mask": mask(F.col("produced_mana")),
        "keywords": listed("card_keywords"),
        "frames": listed("card_frame_data"),
        "powers": numbers("power", "creature_power"),
        "toughnesses": numbers("toughness", "creature_toughness"),
        "loyalties": numbers("loyalty", "planeswalker_loyalty"),
        "face_costs": costs,
        "cost_symbols": F.when(permanent, F.transform(symbols(F.coalesce("mana_cost_text", F.array_join(F.transform(f, lambda x: x["mana_cost"]), ""))), lambda s: F.btrim(s, F.lit("{} ")))),
        "oracle_tags": F.coalesce("card_oracle_tags", F.array().cast(_STRINGS)),
        "art_tags": F.coalesce("card_art_tags", F.array().cast(_STRINGS)),
        "rarity": F.col("card_rarity_int").cast("int"),
        "set_code": lower("card_set_code"),
        "set_type": lower("card_set_type"),
        "legalities": F.col("card_legalities"),
        "lang": lower("card_lang"),
        "layouts": F.transform(of_faces("layout", F.col("card_layout")), F.lower),
        "border": lower("card_border"),
        "watermarks": F.transform(of_faces("watermark", F.col("card_watermark")), F.lower),
        "released": F.col("released_at").try_cast("date"),
        "collector_key": natural_key(F.col("collector_number")),
        "artwork": F.array_distinct(F.array_compact(F.concat(F.array(F.col("illustration_id")), F.transform(f, lambda x: x["illustration_id"])))),
    }
    df = df.withColumns(search)
    text_column = F.col("type_line_lower")
    types = F.split(F.split(F.col("type_line"), "—")[0], r"\s+")
    tags = F.array_compact(F.array(
        F.when(F.size("printed_name_tag") > 0, F.lit("localizedname")),
        F.when(F.contains(text_column, F.lit("creature")) & ~F.contains(text_column, F.lit("land")) & F.coalesce(F.length(F.btrim("front_text_bare")) == 0, F.lit(False)), F.lit("vanilla")),
    ))
    printed = (F.length("printed_name") > 0) | F.exists(f, lambda x: F.length(x["printed_name"]) > 0)
    df = df.withColumn("printed_name_tag", F.when(printed, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))
    return df.withColumns({
        "is_tags": F.array_union(listed("card_is_tags"), tags),
        "types": F.filter(types, lambda t: F.length(t) > 0),
        "artist_entities": F.array_compact(F.array("artist_collated")),
        # a row of no card stands for itself
        "card_key": F.coalesce("oracle_id", F.concat(F.lit("row "), "scryfall_id")),
    }).drop("printed_name_tag", "front_text_bare")


def _spellings(df: DataFrame, artist_ids: str) -> DataFrame:
    """(scryfall_id, more): the spellings of a row's artists, where there are several."""
    credits = F.split(F.col("card_artist"), " & ")
    ids = F.col(artist_ids)
    pairs = F.when(F.size(ids) == 1, F.array(F.struct(ids[0].alias("id"), F.col("card_artist").alias("credit")))).when(F.size(ids) == F.size(credits), F.zip_with(ids, credits, lambda i, c: F.struct(i.alias("id"), c.alias("credit"))))
    named = df.select("scryfall_id", F.explode(pairs).alias("p")).select("scryfall_id", F.col("p.id").alias("artist"), collate(F.col("p.credit")).alias("spelling"))
    spellings = named.groupBy("artist").agg(F.collect_set("spelling").alias("spellings")).where(F.size("spellings") > 1)
    return named.join(spellings, "artist").groupBy("scryfall_id").agg(F.array_distinct(F.flatten(F.collect_list("spellings"))).alias("more"))


def _spelt(df: DataFrame, more: DataFrame) -> DataFrame:
    return df.join(more, "scryfall_id", "left").withColumn("artist_entities", F.array_union("artist_entities", F.coalesce("more", F.array().cast(_STRINGS)))).drop("more")


def with_artist_spellings(df: DataFrame, artist_ids: str) -> DataFrame:
    """Prepared rows whose artists also answer to the other spellings under which the same artist id occurs.

    ``artist_ids`` is an array of ids in the order of the credits, which " & " separates; one id stands for the whole
    credit, and credits that do not match their ids in number name nobody.
    """
    return _spelt(df, _spellings(df, artist_ids))


def _once_printed(df: DataFrame) -> DataFrame:
    """``df``, which needs an ``oracle_id`` and a ``set_code``, with ``one``: whether the card was printed in one set only."""
    sets = df.groupBy("oracle_id").agg((F.count_distinct("set_code") == 1).alias("one")).where("oracle_id is not null")
    return left_join_unique(df, sets, ["oracle_id"], df.count())


def _tagged(df: DataFrame) -> DataFrame:
    return df.withColumn("is_tags", F.when(F.col("one"), F.array_union("is_tags", F.array(F.lit("unique")))).otherwise(F.col("is_tags"))).drop("one")


def with_unique_tag(df: DataFrame) -> DataFrame:
    """Prepared rows with the property ``unique`` where a card was printed in one set only, whatever the language."""
    return _tagged(_once_printed(df))


def _fitting(df: DataFrame) -> DataFrame:
    """(scryfall_id, _fits): the artwork that a row with unknown illustrations fits."""
    ids = F.col("face_illustrations")
    known = F.filter(ids, lambda i: i.isNotNull())
    incomplete = df.where(F.exists(ids, lambda i: i.isNull()) & (F.size(known) > 0)).select("scryfall_id", "card_key", ids.alias("part"), known[0].alias("one"))
    whole = df.where(~F.exists(ids, lambda i: i.isNull()) & (F.size(ids) > 0)).select("card_key", ids.alias("all")).distinct()
    places = whole.select("card_key", "all", F.explode(F.array_distinct("all")).alias("one"))
    fits = F.forall(F.zip_with("part", "all", lambda p, a: F.coalesce(p == a, F.lit(True))), lambda x: x) & (F.size("part") == F.size("all"))
    return incomplete.join(places, ["card_key", "one"]).where(fits).groupBy("scryfall_id").agg(F.min("all").alias("_fits"))


def _unified(df: DataFrame, chosen: DataFrame) -> DataFrame:
    return df.join(chosen, "scryfall_id", "left").withColumn("artwork", F.coalesce("_fits", F.array_compact("face_illustrations"))).drop("_fits")


def with_unified_artworks(df: DataFrame) -> DataFrame:
    """Prepared rows whose faces' illustrations are partly unknown, under the artwork of a row of the same card that they
    fit: equal wherever both are known.  Of several the least; rows of which nothing is known stay together.

    ``df`` needs ``face_illustrations``, an array with a place for every face, null where unknown.
    """
    return _unified(df, _fitting(df))


def with_card_facts(df: DataFrame, artist_ids: str) -> DataFrame:
    """``with_artist_spellings``, ``with_unified_artworks`` and ``with_unique_tag`` in one.

    Each of them reads its rows several times, so one on top of the other multiplies the plan of the rows.  Here all
    three read ``df``, which should be a kept table, and what they find is kept and joined once.
    """
    more, _ = materialise(_spellings(df, artist_ids), "spellings")
    chosen, _ = materialise(_fitting(df), "fitting")
    one, _ = materialise(_once_printed(df.select("scryfall_id", "oracle_id", "set_code")).select("scryfall_id", "one"), "unique")
    return _tagged(_unified(_spelt(df, more), chosen).join(one, "scryfall_id", "left"))
