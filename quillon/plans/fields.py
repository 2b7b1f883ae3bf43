"""The searchable fields: names, kinds of value, and the columns of the prepared table that answer them.

Adding a field is adding a row here; parser, compiler and explanation read nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass

NUMERIC, TEXT, COLOR, MANA, RARITY, LEGALITY, DATE, YEAR = "numeric", "text", "color", "mana", "rarity", "legality", "date", "year"


@dataclass(frozen=True)
class Field:
    """``column`` of the prepared table; ``how`` picks the predicate (see ``compile``); ``said`` explains it."""

    column: str
    aliases: tuple[str, ...]
    kind: str
    how: str
    said: str


def _f(column: str, aliases: str, kind: str, how: str, said: str) -> Field:
    return Field(column, tuple(aliases.split()), kind, how, said)


FIELDS: tuple[Field, ...] = (
    _f("artist_entities", "artist a", TEXT, "artist", "the artist"),
    _f("face_color_masks", "color colors colour colours c", COLOR, "face_mask", "the color"),
    _f("identity_mask", "color_identity coloridentity id identity ci commander", COLOR, "identity", "the color identity"),
    _f("frames", "frame", TEXT, "title_member", "the frame"),
    _f("keywords", "keyword kw", TEXT, "member", "the keyword"),
    _f("name_collated", "name", TEXT, "name", "the name"),
    _f("type_line_lower", "type types t subtype subtypes", TEXT, "line", "the type"),
    _f("cmc", "cmc mv manavalue", NUMERIC, "number", "the mana value"),
    _f("powers", "power pow", NUMERIC, "any_number", "the power"),
    _f("toughnesses", "toughness tou", NUMERIC, "any_number", "the toughness"),
    _f("loyalties", "loyalty loy", NUMERIC, "any_number", "the loyalty"),
    _f("face_costs", "mana m", MANA, "costs", "the mana cost"),
    _f("cost_symbols", "devotion", MANA, "devotion", "the devotion"),
    _f("price_usd", "usd", NUMERIC, "number", "the USD price"),
    _f("price_eur", "eur", NUMERIC, "number", "the EUR price"),
    _f("price_tix", "tix", NUMERIC, "number", "the TIX price"),
    _f("produced_mask", "produces", COLOR, "mask", "the mana it produces"),
    _f("oracle_id", "oracleid oracle_id", TEXT, "equal", "the oracle id"),
    _f("oracle_text_bare", "oracle o", TEXT, "line", "the rules text"),
    _f("oracle_text_lower", "fulloracle fo", TEXT, "line", "the full rules text"),
    _f("flavor_text_lower", "flavor ft", TEXT, "line", "the flavor text"),
    _f("oracle_tags", "oracle_tags otag oracletag function", TEXT, "slug", "the card tag"),
    _f("art_tags", "art_tags art atag arttag", TEXT, "slug", "the art tag"),
    _f("is_tags", "is has", TEXT, "member", "the property"),
    _f("rarity", "rarity r", RARITY, "number", "the rarity"),
    _f("set_code", "set s e", TEXT, "equal", "the set"),
    _f("collector_number", "number cn", TEXT, "exact", "the collector number"),
    _f("legalities", "format f legal banned restricted", LEGALITY, "legality", "the format"),
    _f("lang", "lang language", TEXT, "lang", "the language"),
    _f("set_type", "set_type settype st", TEXT, "equal", "the set type"),
    _f("layouts", "layout", TEXT, "member", "the layout"),
    _f("border", "border", TEXT, "equal", "the border"),
    _f("watermarks", "watermark wm", TEXT, "member", "the watermark"),
    _f("released", "date", DATE, "date", "the release date"),
    _f("released", "year", YEAR, "date", "the release year"),
)
BY_ALIAS: dict[str, Field] = {a: f for f in FIELDS for a in f.aliases}
#: Fields that compare as numbers when the value starts with one, else as text.
NUMBER_TWIN = {"number": _f("collector_number_int", "number", NUMERIC, "number", "the collector number"), "cn": _f("collector_number_int", "cn", NUMERIC, "number", "the collector number")}
DIRECTIVES = ("unique", "sort", "order", "direction", "dir", "prefer")

# Rarities in rising order, formats by letter, colours and their named groups.
RARITIES = {"common": 0, "uncommon": 1, "rare": 2, "special": 3, "mythic": 4, "bonus": 5}
RARITY_LETTERS = {"c": 0, "u": 1, "r": 2, "s": 3, "m": 4, "b": 5}
FORMAT_LETTERS = {"m": "modern", "s": "standard", "l": "legacy", "p": "pauper", "c": "commander", "v": "vintage", "h": "historic"}
COLORS = "wubrg"
COLOR_WORDS = {
    "white": "w", "blue": "u", "black": "b", "red": "r", "green": "g", "colorless": "c", "colourless": "c", "brown": "c",
    "azorius": "wu", "dimir": "ub", "rakdos": "br", "gruul": "rg", "selesnya": "gw",
    "orzhov": "wb", "izzet": "ur", "golgari": "bg", "boros": "rw", "simic": "gu",
    "bant": "gwu", "esper": "wub", "grixis": "ubr", "jund": "brg", "naya": "rgw",
    "abzan": "wbg", "jeskai": "urw", "sultai": "bgu", "mardu": "rwb", "temur": "gur",
    "yore-tiller": "wubr", "glint-eye": "ubrg", "dune-brood": "brgw", "ink-treader": "rgwu", "witch-maw": "gwub",
    "artifice": "wubr", "chaos": "ubrg", "aggression": "brgw", "altruism": "rgwu", "growth": "gwub",
    "rainbow": "wubrg", "all": "wubrgc",
}
MANY_COLORS = ("m", "gold", "multicolor", "multicolour", "multicolored", "multicoloured")
YEARS = (1992, 2040)
