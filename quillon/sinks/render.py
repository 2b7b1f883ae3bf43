"""Results as text: rows, columns, CSV, cards, lists, errors."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.search import PAGE, Result
from quillon.plans.fields import COLORS, RARITIES
from quillon.plans.query import QueryError

#: Result fields by the name that callers use; the first ten are what they get unasked.
FIELDS = {
    "name": "card_name", "set_code": "card_set_code", "collector_number": "collector_number", "power": "creature_power", "toughness": "creature_toughness", "mana_cost": "mana_cost_text",
    "oracle_text": "oracle_text", "set_name": "set_name", "type_line": "type_line", "scryfall_id": "scryfall_id", "oracle_id": "oracle_id", "cmc": "cmc", "rarity": "card_rarity_int",
    "artist": "card_artist", "price_usd": "price_usd", "price_eur": "price_eur", "price_tix": "price_tix", "released_at": "released_at", "lang": "card_lang", "printed_name": "printed_name", "edhrec_rank": "edhrec_rank",
}
DEFAULT_FIELDS = tuple(FIELDS)[:10]
# The columns of the CSV form.
CSV_FIELDS = (
    "multiverse_id", "mtgo_id", "set", "collector_number", "lang", "rarity", "name", "mana_cost", "cmc", "type_line", "artist",
    "usd_price", "usd_foil_price", "eur_price", "tix_price", "image_uri", "scryfall_uri", "scryfall_id",
)
# Layouts of two pictures, whose faces own what other cards have at the top; layouts that the joined name stands for.
TWO_PICTURES = ("art_series", "double_faced_token", "modal_dfc", "reversible_card", "transform")
JOINED_NAMES = ("double_faced_token", "reversible_card", "split")


def select_fields(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """The asked fields, each once, in order; Catalyst then reads no other columns."""
    names = list(dict.fromkeys(fields if fields is not None else DEFAULT_FIELDS))
    unknown = [n for n in names if n not in FIELDS]
    if unknown or not names:
        raise QueryError(f"unknown fields: {', '.join(unknown)}" if unknown else "no fields")
    return df.select(*(F.col(FIELDS[n]).alias(n) for n in names))


def rows_json(df: DataFrame) -> DataFrame:
    """(value): each row as a JSON object, null fields included."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def columns_json(page: DataFrame, order: list[Column]) -> str:
    """A page as one JSON object of lists, a list a field, all in the page's order."""
    table = page.orderBy(*order).toArrow() if order else page.toArrow()
    return json.dumps({name: table[name].to_pylist() for name in table.column_names}, default=str, ensure_ascii=False)


def rarity_word(rank: Column) -> Column:
    return F.coalesce(*(F.when(rank == n, F.lit(w)) for w, n in RARITIES.items()))


def decimal_text(c: Column) -> Column:
    """A number with at least one decimal: 1 is 1.0, 0.5 stays 0.5."""
    return c.cast("double").cast("string")


def csv_columns(df: DataFrame, images: str = "/images") -> DataFrame:
    """The columns of the CSV form, all text; null and empty stay apart."""
    c = F.col
    word = rarity_word(c("card_rarity_int"))
    values = {
        "multiverse_id": F.get("multiverse_ids", F.lit(0)), "mtgo_id": F.try_element_at("external_ids", F.lit("mtgo_id")), "set": F.upper("card_set_code"), "collector_number": c("collector_number"), "lang": c("card_lang"),
        "rarity": F.upper(F.substring(word, 1, 1)), "name": c("card_name"), "mana_cost": c("mana_cost_joined"), "cmc": decimal_text(c("cmc")), "type_line": c("type_line"), "artist": c("card_artist"),
        "usd_price": decimal_text(c("price_usd_plain")), "usd_foil_price": decimal_text(c("price_usd_foil")), "eur_price": decimal_text(c("price_eur_plain")), "tix_price": decimal_text(c("price_tix")),
        "image_uri": image_uris(images)["large"], "scryfall_uri": card_uri(), "scryfall_id": c("scryfall_id"),
    }
    return df.select(*(values[k].cast("string").alias(k) for k in CSV_FIELDS))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header; quotes only where needed, null as nothing and empty text as two quotes."""
    csv_columns(df).write.option("header", True).option("nullValue", "").option("emptyValue", '""').option("escape", '"').csv(path)


def csv_cell(value: str | None) -> str:
    """One cell of the same form."""
    if value is None:
        return ""
    return '"' + value.replace('"', '""') + '"' if value == "" or any(x in value for x in '",\r\n') else value


def csv_text(page: DataFrame) -> str:
    """A page as CSV."""
    lines = [",".join(CSV_FIELDS), *(",".join(csv_cell(v) for v in r) for r in csv_columns(page).collect())]
    return "\n".join(lines) + "\n"


def card_text() -> Column:
    """A card as plain lines: name with cost, type, rules, power with toughness or loyalty or defense; its faces one after the
    other, a blank line between them."""

    def lines(name: Column, cost: Column, kind: Column, rules: Column, power: Column, toughness: Column, loyalty: Column, defense: Column) -> Column:
        stats = F.when(power.isNotNull() & toughness.isNotNull(), F.concat(power, F.lit("/"), toughness)).when(loyalty.isNotNull(), F.concat(F.lit("Loyalty: "), loyalty)).when(defense.isNotNull(), F.concat(F.lit("Defense: "), defense))
        some = lambda c: F.nullif(c, F.lit(""))
        return F.concat_ws("\n", F.concat_ws(" ", name, some(cost)), some(kind), some(rules), stats)

    number = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")
    own = lines(
        F.col("card_name"), F.col("mana_cost_text"), F.col("type_line"), F.col("oracle_text"), F.coalesce("creature_power_text", number("creature_power")), F.coalesce("creature_toughness_text", number("creature_toughness")),
        F.coalesce("planeswalker_loyalty_text", F.col("planeswalker_loyalty").cast("string")), F.lit(None).cast("string"),
    )
    faces = F.transform("faces", lambda f: lines(F.coalesce(f["name"], F.lit("")), f["mana_cost"], f["type_line"], f["oracle_text"], f["power"], f["toughness"], f["loyalty"], f["defense"]))
    return F.when(F.size("faces") > 0, F.array_join(faces, "\n\n")).otherwise(own)


def prices(df_prices: dict[str, str] | None = None) -> Column:
    """Prices as texts of two decimals under their names; unknown ones null."""
    names = df_prices or {"usd": "price_usd_plain", "usd_foil": "price_usd_foil", "usd_etched": "price_usd_etched", "eur": "price_eur_plain", "eur_foil": "price_eur_foil", "tix": "price_tix"}
    return F.struct(*(F.round(F.col(c), 2).cast("decimal(12,2)").cast("string").alias(k) for k, c in names.items()))


#: Signs that stand in an address as they are, which ``url_encode`` encodes.
_LITERAL_SIGNS = "!&()+:;="


def url_slug(c: Column) -> Column:
    """A name as it stands in an address: no quotes, commas, points or slashes, a hyphen for a run of blanks, the rest
    percent-encoded."""
    out = F.url_encode(F.regexp_replace(F.regexp_replace(F.lower(c), "['\",./“”]", ""), " +", "-"))
    for sign in _LITERAL_SIGNS:
        out = F.replace(out, F.lit(f"%{ord(sign):02X}"), F.lit(sign))
    return F.replace(out, F.lit("*"), F.lit("%2A"))


#: The sizes in which a picture is kept, by name, with their file's ending.
IMAGE_SIZES = {"small": "jpg", "normal": "jpg", "large": "jpg", "png": "png", "art_crop": "jpg", "border_crop": "jpg", "thumb": "webp", "grid": "webp", "display": "webp", "art": "webp", "crop": "webp"}


def card_uri() -> Column:
    """The address of a printing's page; English needs no language in it."""
    lang = F.when(F.lower("card_lang") != "en", F.concat(F.lit("/"), F.lower("card_lang"))).otherwise("")
    return F.concat(F.lit("/card/"), F.lower("card_set_code"), F.lit("/"), F.url_encode("collector_number"), F.coalesce(lang, F.lit("")), F.lit("/"), url_slug(F.col("card_name")))


def image_uris(base: str, side: str | Column = "front") -> Column:
    """The addresses of a printing's pictures, which follow from its id."""
    i = F.col("scryfall_id")
    side = F.lit(side) if isinstance(side, str) else side
    path = lambda size, end: F.concat(F.lit(f"{base.rstrip('/')}/{size}/"), side, F.lit("/"), F.substring(i, 1, 1), F.lit("/"), F.substring(i, 2, 1), F.lit("/"), i, F.lit(f".{end}"))
    return F.struct(*(path(size, end).alias(size) for size, end in IMAGE_SIZES.items()))


def ruling_object() -> Column:
    """A ruling as a JSON object."""
    return F.to_json(F.struct(F.lit("ruling").alias("object"), "oracle_id", "source", "published_at", "comment"))


def _face_objects(two: Column, images: str) -> Column:
    """The faces as objects: what a face lacks is left out, but for an empty cost or text, which is a value."""
    some = lambda c: F.nullif(c, F.lit(""))
    full = lambda c: F.when(F.size(c) > 0, c)
    reversible = F.col("card_layout") == "reversible_card"

    def one(f: Column, i: Column) -> Column:
        texts = ("type_line", "power", "toughness", "loyalty", "defense", "flavor_text", "watermark", "artist", "artist_id", "illustration_id", "printed_name", "printed_type_line", "printed_text", "flavor_name", "layout")
        side = F.when(i == 0, F.lit("front")).otherwise(F.lit("back"))
        return F.struct(
            F.lit("card_face").alias("object"), F.when(reversible, F.col("oracle_id")).alias("oracle_id"), F.when(reversible, F.col("cmc")).alias("cmc"), some(f["name"]).alias("name"), f["mana_cost"].alias("mana_cost"),
            f["oracle_text"].alias("oracle_text"), F.when(two, f["colors"]).alias("colors"), full(f["color_indicator"]).alias("color_indicator"), *(some(f[t]).alias(t) for t in texts), F.when(two, image_uris(images, side)).alias("image_uris"),
        )

    return F.transform("faces", one)


def card_object(links: dict[str, str] | None = None, images: str = "/images", back: str | None = None) -> Column:
    """A card as one JSON object.

    Some keys are always there, null where unknown; others only where a card has them.  Cards of two pictures have on
    their faces what others have at the top, and a reversible card has its card's id, value and type there too.  ``links``
    maps names of related addresses to what a card's quoted name is put behind; ``back`` is the id of the common back.
    """
    c, lit = F.col, F.lit
    letters = lambda m: F.filter(F.array(*(F.when(c(m).bitwiseAND(lit(1 << i)) > 0, lit(x)) for i, x in enumerate(COLORS.upper()))), lambda x: x.isNotNull())
    some = lambda x: F.nullif(x, lit(""))
    listed = lambda x: F.coalesce(c(x), F.array().cast("array<string>"))
    flag = lambda x: F.coalesce(c(x), lit(False)).alias(x)
    full = lambda x: F.when(F.size(x) > 0, c(x)).alias(x)
    faced = F.size("faces") > 0
    two = faced & F.coalesce(c("card_layout").isin(*TWO_PICTURES), lit(False))
    reversible = F.coalesce(c("card_layout") == "reversible_card", lit(False))
    one = lambda x: F.when(~two, x)
    sold = (F.size(listed("games")) == 0) | F.arrays_overlap(listed("games"), F.array(lit("paper"), lit("mtgo")))
    front = F.when(faced & ~F.coalesce(c("card_layout").isin(*JOINED_NAMES), lit(False)), F.substring_index("card_name", " // ", 1)).otherwise(c("card_name"))
    related = [F.concat(lit(prefix), F.url_encode(front)).alias(k) for k, prefix in (links or {}).items()]
    other = lambda k: F.try_element_at("external_ids", lit(k)).alias(k)
    kept = lambda k: some(F.try_element_at("residue", lit(k))).alias(k)
    always = F.struct(
        lit("card").alias("object"), c("scryfall_id").alias("id"), F.coalesce("multiverse_ids", F.array().cast("array<bigint>")).alias("multiverse_ids"), c("card_name").alias("name"), F.lower("card_lang").alias("lang"), c("released_at"),
        F.concat(lit("/cards/"), c("scryfall_id")).alias("uri"), card_uri().alias("scryfall_uri"), c("card_layout").alias("layout"), flag("highres_image"), c("image_status"),
        letters("identity_mask").alias("color_identity"), F.coalesce("card_keywords_printed", listed("card_keywords")).alias("keywords"), listed("games").alias("games"), F.array_contains("is_tags", lit("reserved")).alias("reserved"),
        listed("finishes").alias("finishes"), flag("oversized"), flag("promo"), flag("reprint"), flag("variation"), c("set_id"), F.lower("card_set_code").alias("set"), c("set_name"), c("card_set_type").alias("set_type"),
        F.concat(lit("/sets/"), c("set_id")).alias("set_uri"), F.concat(lit("/cards/search?order=set&q=e%3A"), F.lower("card_set_code"), lit("&unique=prints")).alias("set_search_uri"),
        F.concat(lit("/cards/"), c("scryfall_id"), lit("/rulings")).alias("rulings_uri"), F.concat(lit("/cards/search?order=released&q=oracleid%3A"), c("oracle_id"), lit("&unique=prints")).alias("prints_search_uri"),
        c("collector_number"), flag("digital"), rarity_word(c("card_rarity_int")).alias("rarity"), c("card_artist").alias("artist"), c("card_border").alias("border_color"), flag("full_art"), flag("textless"), flag("booster"), flag("story_spotlight"),
        prices().alias("prices"),
    )
    plain = F.struct(c("mana_cost_text").alias("mana_cost"), c("oracle_text").alias("oracle_text"))
    pictured = F.struct(letters("color_mask").alias("colors"), c("illustration_id"), *([lit(back).alias("card_back_id")] if back else []))
    whole = F.struct(c("oracle_id"), c("cmc"), c("type_line"))
    optional = F.struct(
        some(c("printed_name")).alias("printed_name"), some(c("flavor_name")).alias("flavor_name"), some(c("printed_type_line")).alias("printed_type_line"), some(c("life_modifier")).alias("life_modifier"), some(c("hand_modifier")).alias("hand_modifier"),
        F.when(faced, _face_objects(two, images)).alias("card_faces"), F.when(faced & ~two, c("mana_cost_joined")).alias("mana_cost"), one(image_uris(images)).alias("image_uris"), F.when(~faced, some(c("printed_text"))).alias("printed_text"),
        one(some(c("creature_power_text"))).alias("power"), one(some(c("creature_toughness_text"))).alias("toughness"), one(some(c("planeswalker_loyalty_text"))).alias("loyalty"), one(some(c("flavor_text"))).alias("flavor_text"),
        F.when(~faced, some(c("card_watermark"))).alias("watermark"), some(c("frame")).alias("frame"), c("edhrec_rank"), kept("penny_rank"), other("arena_id"), other("mtgo_id"), kept("mtgo_foil_id"), other("tcgplayer_id"), kept("tcgplayer_etched_id"),
        other("cardmarket_id"), kept("security_stamp"), one(full("color_indicator")).alias("color_indicator"), full("produced_mana"), full("promo_types"), full("frame_effects"), c("card_legalities").alias("legalities"),
        *([F.when(sold, F.struct(*related)).alias("related_uris")] if related else []),
    )
    with_nulls = lambda x: F.to_json(x, {"ignoreNullFields": "false"})
    members = lambda text: F.nullif(F.substring(text, 2, 1 << 30).substr(lit(1), F.length(text) - 2), lit(""))
    parts = [with_nulls(always), F.when(~reversible, with_nulls(whole)), F.when(~two, with_nulls(pictured)), F.when(~faced, with_nulls(plain)), F.to_json(optional)]
    return F.concat(lit("{"), F.concat_ws(",", *(members(p) for p in parts)), lit("}"))


def page_number(text: str | None) -> int:
    """A page from a parameter: its leading digits, else 1, and never less."""
    digits = ""
    for ch in (text or "").strip():
        if not ch.isdigit():
            break
        digits += ch
    return max(1, int(digits or 1))


def list_object(result: Result, data: list, number: int = 1, not_found: list | None = None, size: int = PAGE) -> dict:
    """The envelope of a page: total, whether more follow and which page, warnings, data.

    No match at all, and a page past the end, are errors of their own.
    """
    total = result.total()
    if total == 0:
        return error_object("not_found", 404, "no cards match", result.warnings)
    if (number - 1) * size >= total:
        return error_object("validation_error", 422, "this page is past the end of the list", result.warnings)
    more = number * size < total
    out = {"object": "list", "total_cards": total, "has_more": more}
    if not_found is not None:
        out = {"object": "list", "not_found": not_found, "total_cards": total, "has_more": more}
    if more:
        asked = result.options
        out["next_page"] = {"page": number + 1, "order": asked.orderby, "dir": asked.direction, "unique": asked.unique, "include_extras": asked.include_extras, "include_multilingual": asked.include_multilingual, "include_variations": asked.include_variations}
    if result.warnings:
        out["warnings"] = result.warnings
    return out | {"data": data}


def error_object(code: str, status: int, details: str, warnings: list[str] | None = None) -> dict:
    """An error in the same form of envelope."""
    return {"object": "error", "code": code, "status": status, "warnings": warnings or None, "details": details}
