"""Lists over the whole catalogue: the named catalogs, the symbols of mana, the sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.columns import clean_id
from quillon.plans.fields import COLORS

# The catalogs' names; types above the others; types whose subtypes have a catalog of their own.
CATALOGS = (
    "card-names", "artist-names", "word-bank", "supertypes", "card-types", "artifact-types", "battle-types", "creature-types", "enchantment-types", "land-types", "planeswalker-types", "spell-types",
    "powers", "toughnesses", "loyalties", "watermarks", "keyword-abilities", "keyword-actions", "ability-words", "flavor-words",
)
SUPERTYPES = ("Basic", "Elite", "Host", "Legendary", "Ongoing", "Snow", "World")
SUBTYPES_OF = {
    "artifact-types": ("Artifact",), "battle-types": ("Battle",), "creature-types": ("Creature", "Kindred", "Tribal"), "enchantment-types": ("Enchantment",), "land-types": ("Land",), "planeswalker-types": ("Planeswalker",),
    "spell-types": ("Instant", "Sorcery"),
}
#: Catalogs that only a published list can tell apart; the rows hold all of these words as keywords.
PUBLISHED = ("keyword-actions", "ability-words", "flavor-words")


def _halves(line: Column) -> tuple[Column, Column]:
    """The words before and after the dash of a type line."""
    words = lambda half: F.filter(F.split(F.coalesce(half, F.lit("")), r"\s+"), lambda w: F.length(w) > 0)
    halves = F.split(line, "—", 2)
    return words(F.get(halves, F.lit(0))), words(F.get(halves, F.lit(1)))


def catalog(prepared: DataFrame, name: str, published: DataFrame | None = None) -> DataFrame:
    """(value): the different values of one of ``CATALOGS``, nulls and empty texts left out.

    Most follow from the rows.  ``published`` (catalog, value) is a list to read instead; the catalogs of ``PUBLISHED``
    are empty without it.  Raises ValueError for another name; names are compared as they are written.
    """
    if name not in CATALOGS:
        raise ValueError(f"no catalog {name}")
    if published is not None or name in PUBLISHED:
        given = published.where(F.col("catalog") == name).select("value") if published is not None else prepared.select(F.lit(None).cast("string").alias("value")).limit(0)
        return given.where("value <> ''").distinct()
    lines = F.split(F.coalesce("type_line", F.lit("")), " // ")
    types = F.flatten(F.transform(lines, lambda t: _halves(t)[0]))
    shown = lambda own, face: F.concat(F.array(own), F.transform("faces", lambda f: f[face]))
    values = {
        "card-names": F.array("card_name"),
        "artist-names": F.split("card_artist", " & "),
        "word-bank": F.regexp_extract_all(F.lower("card_name"), F.lit(r"([\p{L}\p{N}]+(?:['’\-][\p{L}\p{N}]+)*)"), 1),
        "supertypes": F.array_intersect(types, F.array(*map(F.lit, SUPERTYPES))),
        "card-types": F.array_except(types, F.array(*map(F.lit, SUPERTYPES))),
        "powers": shown(F.coalesce("creature_power_text", F.regexp_replace(F.col("creature_power").cast("string"), r"\.0$", "")), "power"),
        "toughnesses": shown(F.coalesce("creature_toughness_text", F.regexp_replace(F.col("creature_toughness").cast("string"), r"\.0$", "")), "toughness"),
        "loyalties": shown(F.coalesce("planeswalker_loyalty_text", F.col("planeswalker_loyalty").cast("string")), "loyalty"),
        "watermarks": F.col("watermarks"),
        "keyword-abilities": F.col("keywords"),
    }
    if name in SUBTYPES_OF:
        of = F.array(*map(F.lit, SUBTYPES_OF[name]))
        values[name] = F.flatten(F.transform(lines, lambda t: F.when(F.arrays_overlap(_halves(t)[0], of), _halves(t)[1]).otherwise(F.array().cast("array<string>"))))
    return prepared.select(F.explode(values[name]).alias("value")).where("value <> ''").distinct()


def symbology(prepared: DataFrame) -> DataFrame:
    """(symbol, mana_value, colors, hybrid, phyrexian, n_cards): every symbol in braces of costs and rules texts, what it
    adds to a cost, its colours in order, and in how many rows it stands.

    A symbol of several parts is worth its dearest, half a symbol half, a variable nothing; other words are worth nothing.
    """
    text = F.concat_ws(" ", "mana_cost_text", F.array_join(F.transform("faces", lambda f: F.coalesce(f["mana_cost"], F.lit(""))), " "), "oracle_text")
    found = F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(r"(\{[^{}\s]+\})"), 1))
    counted = prepared.select(F.explode(found).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n_cards"))
    bare = F.btrim("symbol", F.lit("{}"))
    parts = F.split(bare, "/")
    colored = "^[WUBRGCSP]$"
    worth = F.transform(parts, lambda p: F.when(F.rlike(p, F.lit("^[0-9]{1,9}$")), p.try_cast("double")).when(F.rlike(p, F.lit(colored)), 1.0).when(F.rlike(p, F.lit("^H[WUBRG]$")), 0.5).otherwise(0.0))
    letters = F.array_compact(F.array(*(F.when(F.arrays_overlap(F.transform(parts, lambda p: F.regexp_replace(p, "^H", "")), F.array(F.lit(x))), F.lit(x)) for x in COLORS.upper())))
    return counted.select("symbol", F.array_max(worth).alias("mana_value"), letters.alias("colors"), (F.size(letters) > 1).alias("hybrid"), F.array_contains(parts, F.lit("P")).alias("phyrexian"), "n_cards")


def set_list(sets: DataFrame) -> DataFrame:
    """The sets, each code once: of repeated rows that of the least id; newest first, then by code, as ``place`` from 0.

    Codes are compared in lower case; rows without a code are none.  A set has so few rows that one task orders them.
    """
    s = sets.withColumns({"code": F.lower(F.btrim("code")), "id": clean_id("id"), "parent_set_code": F.lower("parent_set_code")}).where("code <> ''")
    once = Window.partitionBy("code").orderBy(F.col("id").asc_nulls_last(), F.col("released_at").asc_nulls_last(), F.col("set_name").asc_nulls_last(), F.col("set_type").asc_nulls_last())
    one = s.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
    return one.withColumn("place", F.row_number().over(Window.orderBy(F.col("released_at").try_cast("date").desc_nulls_last(), F.col("code").asc())) - 1)
