"""Queries of the search engine over the printings table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import counts, lookup
from quillon.operators.prepare import current, prepare, with_unique_tag
from quillon.operators.search import PAGE, sample, search
from quillon.operators.store import store
from quillon.sources.tables import table

#: Rows of these layouts, set types and type words are extra: no cards to play with.
EXTRA_LAYOUTS = ("art_series", "double_faced_token", "emblem", "planar", "scheme", "token", "vanguard")
EXTRA_TYPES = ("Card", "Token")


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    """The prepared rows: the latest delivery of every printing that is not removed, with its set's type."""
    rows = current(table(spark, d, "printings"), ["imported_at", "row_no"], removed="removed_at")
    # the code is compared in lower case; of repeated rows of a set any one counts, so the least type is taken
    sets = table(spark, d, "card_sets").groupBy(F.lower("code").alias("code")).agg(F.min("set_type").alias("card_set_type"))
    rows = rows.join(sets, F.lower("card_set_code") == F.col("code"), "left").drop("code")
    words = F.split(F.split("type_line", "—")[0], r"\s+")
    extra = F.coalesce(F.col("card_layout").isin(*EXTRA_LAYOUTS), F.lit(False)) | F.coalesce(F.col("card_set_type") == "memorabilia", F.lit(False)) | F.coalesce(F.arrays_overlap(words, F.array(*map(F.lit, EXTRA_TYPES))), F.lit(False))
    return prepare(rows.withColumn("card_is_tags", F.when(extra, F.array(F.lit("extra"))).otherwise(F.array().cast("array<string>"))))


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """The store of a folder's catalogue: built by the first query that needs it, then read by all."""
    return store(spark, [f"{d.rstrip('/')}/{t}.parquet" for t in ("printings", "card_sets")], lambda: catalogue(spark, d))


_CORPUS = f"""
    sets AS (SELECT lower(code) AS code, min(set_type) AS set_type FROM card_sets GROUP BY 1),
    latest AS (
        SELECT *, row_number() OVER (PARTITION BY lower(trim(scryfall_id)) ORDER BY imported_at DESC NULLS LAST, row_no DESC) AS newest
        FROM printings WHERE trim(scryfall_id) <> ''),
    cur AS (
        SELECT l.* REPLACE (lower(trim(scryfall_id)) AS scryfall_id, nullif(lower(trim(oracle_id)), '') AS oracle_id,
                            nullif(lower(trim(illustration_id)), '') AS illustration_id, coalesce(is_canonical, true) AS is_canonical),
               s.set_type,
               regexp_replace(lower(strip_accents(card_name)), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS name_key,
               coalesce(card_layout IN {EXTRA_LAYOUTS}, false) OR coalesce(s.set_type = 'memorabilia', false)
                 OR coalesce(list_has_any(regexp_split_to_array(split_part(type_line, '—', 1), '\\s+'), {list(EXTRA_TYPES)}), false) AS is_extra,
               coalesce(list_reduce(list_transform(list_distinct(card_colors), lambda x: CASE x WHEN 'W' THEN 1 WHEN 'U' THEN 2 WHEN 'B' THEN 4
                 WHEN 'R' THEN 8 WHEN 'G' THEN 16 ELSE 0 END), lambda a, b: a | b, 0), 0) AS mask
        FROM latest l LEFT JOIN sets s ON lower(l.card_set_code) = s.code WHERE newest = 1 AND removed_at IS NULL)"""


def _sql(select: str, more: str = "") -> str:
    return f"WITH {_CORPUS}{', ' + more if more else ''} {select}"


_ALL = {"unique": "printing", "limit": None, "include_multilingual": True, "include_extras": True, "include_variations": True}
_COST = "list_filter(list_transform(card_faces, lambda f: f.mana_cost), lambda c: length(c) > 0)"
_PIPS = "(length(c) - length(replace(c, '{{{0}}}', ''))) / 3"
_GENERIC = "coalesce(try_cast(regexp_extract(c, '\\{([0-9]+)\\}', 1) AS INTEGER), 0)"
_R = _PIPS.format("R")
_OTHER = "length(regexp_replace(regexp_replace(c, '\\{[0-9]+\\}', '', 'g'), '\\{R\\}', '', 'g')) = 0"

#: name -> (query, what SQL says of a matching row)
FILTERS: dict[str, tuple[str, str]] = {
    "par_empty": ("", "true"),
    "par_and_implicit": ("t:creature cmc>=3", "lower(type_line) LIKE '%creature%' AND cmc >= 3"),
    "par_and_explicit": ("t:creature AND cmc<=2", "lower(type_line) LIKE '%creature%' AND cmc <= 2"),
    "par_or_precedence": ("t:land or t:instant cmc>5", "lower(type_line) LIKE '%land%' OR (lower(type_line) LIKE '%instant%' AND cmc > 5)"),
    "par_not_complement": ("-cmc<4", "NOT coalesce(cmc < 4, false)"),
    "par_not_group": ("-(t:land or r:rare)", "NOT (coalesce(lower(type_line) LIKE '%land%', false) OR coalesce(card_rarity_int = 2, false))"),
    "par_group": ("(t:artifact or t:enchantment) r>=rare", "(lower(type_line) LIKE '%artifact%' OR lower(type_line) LIKE '%enchantment%') AND card_rarity_int >= 2"),
    "par_arithmetic": ("cmc+1>usd*2", "cmc + 1 > price_usd * 2"),
    "par_division": ("usd/eur>1.1", "price_usd / nullif(price_eur, 0) > 1.1"),
    "par_cross_column": ("usd>eur", "price_usd > price_eur"),
    "par_signed": ("cmc>-1", "cmc > -1"),
    "cmp_numeric_eq": ("cmc=3", "cmc = 3"),
    "cmp_numeric_ne": ("mv!=3", "cmc <> 3"),
    "cmp_numeric_lt": ("manavalue<2", "cmc < 2"),
    "cmp_rarity": ("r>=mythic", "card_rarity_int >= 4"),
    "cmp_rarity_letter": ("rarity:u", "card_rarity_int = 1"),
    "cmp_date_day": ("date>=2015-06-15", "try_cast(released_at AS DATE) >= DATE '2015-06-15'"),
    "cmp_date_month": ("date:1996-03", "try_cast(released_at AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1996-03-31'"),
    "cmp_date_window": ("date<=2010", "try_cast(released_at AS DATE) <= DATE '2010-12-31'"),
    "cmp_year_ne": ("year!=2014", "NOT (try_cast(released_at AS DATE) BETWEEN DATE '2014-01-01' AND DATE '2014-12-31')"),
    "cmp_year_after": ("year>2018", "try_cast(released_at AS DATE) > DATE '2018-12-31'"),
    "cmp_price": ("usd>=5 eur<20", "price_usd >= 5 AND price_eur < 20"),
    "cmp_number_int": ("cn>=350", "collector_number_int >= 350"),
    "cmp_number_text": ("cn:A-182 or number:97s", "collector_number IN ('A-182', '97s')"),
    "cmp_number_case": ("cn:a-182 or number:A-182", "collector_number IN ('a-182', 'A-182')"),
    "col_superset": ("c:wu", "mask & 3 = 3"),
    "col_exact": ("c=br", "mask = 12"),
    "col_subset": ("c<=gw", "mask & 17 = mask"),
    "col_strict": ("c>g", "mask & 16 = 16 AND mask <> 16"),
    "col_ne": ("c!=r", "mask <> 8"),
    "col_less": ("color<jund", "mask & 28 = mask AND mask <> 28"),
    "col_none": ("c:colorless", "mask = 0"),
    "col_count": ("c>=3", "bit_count(mask) >= 3"),
    "col_many": ("c:multicolor", "bit_count(mask) >= 2"),
    "col_few": ("c!=m", "bit_count(mask) < 2"),
    "txt_name_bare": ("lantern", "name_key LIKE '%lantern%'"),
    "txt_name_accents": ("name:brasuna or name:Kömöm", "name_key LIKE '%brasuna%' OR name_key LIKE '%komom%'"),
    "txt_name_quoted": ("\"er of \" or \"Cálr\"", "lower(card_name) LIKE '%er of %' OR lower(card_name) LIKE '%cálr%'"),
    "txt_name_words": ("warden of", "name_key LIKE '%warden%' AND name_key LIKE '%of%'"),
    "txt_name_exact": ("!\"Nirnen Basin\"", "name_key = 'nirnenbasin'"),
    "txt_name_regex": ("name:/^s.*n$/", "regexp_matches(lower(card_name), '^s[^\\n]*n$')"),
    "txt_regex": ("t:/heron|otter/", "regexp_matches(lower(type_line), 'heron|otter')"),
    "txt_regex_class": ("t:/crea[st]ure \\S+ b/", "regexp_matches(lower(type_line), 'crea[st]ure \\S+ b')"),
    "txt_regex_plain": ("t:/token creature/", "lower(type_line) LIKE '%token creature%'"),
    "txt_type_part": ("t:creat", "lower(type_line) LIKE '%creat%'"),
    "txt_type_phrase": ("t:\"basic land\"", "lower(type_line) LIKE '%basic land%'"),
    "txt_artist": ("a:soamane or a:\"lilor jyth\"", "regexp_matches(regexp_replace(lower(strip_accents(card_artist)), '[^\\p{L}\\p{N}]+', '', 'g'), 'soamane|lilorjyth')"),
    "txt_lang": ("lang:ja", "lower(card_lang) = 'ja'"),
    "txt_lang_any": ("lang:any cmc=1", "cmc = 1"),
    "txt_border": ("border:borderless", "lower(card_border) = 'borderless'"),
    "txt_layout": ("layout:split", "lower(card_layout) = 'split'"),
    "txt_set_type": ("st:core", "lower(set_type) = 'core'"),
    "txt_set": ("e:m3m or s:KH2", "lower(card_set_code) IN ('m3m', 'kh2')"),
    "txt_not_equal": ("t!=creature", "false"),
    "txt_compared": ("t>creature", "false"),
    "set_keyword": ("kw:duskwalk", "list_contains(list_transform(card_keywords, lambda x: lower(x)), 'duskwalk')"),
    "set_keyword_not": ("-keyword:hover", "NOT coalesce(list_contains(list_transform(card_keywords, lambda x: lower(x)), 'hover'), false)"),
    "set_extra": ("is:extra", "is_extra"),
    "leg_legal": ("f:modern", "card_legalities['modern'] IN ('legal', 'restricted')"),
    "leg_letter": ("legal:v", "card_legalities['vintage'] IN ('legal', 'restricted')"),
    "leg_banned": ("banned:brawl", "card_legalities['brawl'] = 'banned'"),
    "leg_restricted": ("restricted:pauper", "card_legalities['pauper'] = 'restricted'"),
    "man_contains": ("m:{1}{R}", f"len(list_filter({_COST}, lambda c: {_R} >= 1 AND {_GENERIC} >= 1)) > 0"),
    "man_exact": ("m={1}{R}", f"len(list_filter({_COST}, lambda c: {_R} = 1 AND {_GENERIC} = 1 AND {_OTHER})) > 0"),
    "man_at_most": ("m<={3}{R}", f"len(list_filter({_COST}, lambda c: {_R} <= 1 AND {_GENERIC} <= 3 AND {_OTHER})) > 0"),
    "der_historic": ("is:historic", "lower(type_line) LIKE '%legendary%' OR lower(type_line) LIKE '%artifact%' OR lower(type_line) LIKE '%saga%'"),
    "der_permanent": ("is:permanent -t:land", "regexp_matches(lower(type_line), 'creature|artifact|enchantment|planeswalker|battle') AND NOT coalesce(lower(type_line) LIKE '%land%', false)"),
    "der_dfc": ("is:dfc", "lower(card_layout) IN ('transform', 'modal_dfc', 'art_series', 'double_faced_token', 'reversible_card')"),
    "der_spell": ("is:spell", "regexp_matches(lower(type_line), 'artifact|battle|creature|enchantment|instant|kindred|planeswalker|sorcery')"),
    "der_has_artist": ("has:artist", "length(regexp_replace(lower(strip_accents(card_artist)), '[^\\p{L}\\p{N}]+', '', 'g')) > 0"),
    "der_unknown": ("is:nonsense or cmc=0", "cmc = 0"),
}


def _filter(query: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return search(corpus(spark, d), query, **_ALL).matches.select("scryfall_id", "card_name")

    run.__doc__ = f"All printings that match {query!r}."
    return run


_PREFER_SQL = {
    "default": "", "oldest": "try_cast(released_at AS DATE) ASC NULLS LAST,", "newest": "try_cast(released_at AS DATE) DESC NULLS LAST,",
    "usd_low": "price_usd ASC NULLS LAST,", "usd_high": "price_usd DESC NULLS LAST,", "promo": "",
}
_SCORE = "is_canonical DESC, CASE WHEN NOT isnan(prefer_score) THEN prefer_score END DESC NULLS LAST, scryfall_id ASC"
_GROUP = {"card": "coalesce(oracle_id, 'row ' || scryfall_id)", "artwork": "coalesce(oracle_id, 'row ' || scryfall_id), coalesce(illustration_id, '')"}


def _choice_sql(where: str, unique: str, prefer: str) -> str:
    if unique == "printing":
        return f"SELECT * FROM cur WHERE coalesce({where}, false)"
    return f"SELECT * EXCLUDE (choice) FROM (SELECT *, row_number() OVER (PARTITION BY {_GROUP[unique]} ORDER BY {_PREFER_SQL[prefer]} {_SCORE}) AS choice FROM cur WHERE coalesce({where}, false)) WHERE choice = 1"


_ORDER_SQL = {
    "artist": ("regexp_replace(lower(strip_accents(card_artist)), '[^\\p{L}\\p{N}]+', '', 'g')", "low"), "cmc": ("cmc", "low"), "color": ("bit_count(mask), mask", "low"),
    "cubecobra": ("NULL", "low"), "edhrec": ("edhrec_rank", "high"), "eur": ("price_eur", "low"), "name": ("name_key", "low"), "power": ("NULL", "low"),
    "rarity": ("card_rarity_int", "low"), "released": ("try_cast(released_at AS DATE)", "low"),
    "set": ("lower(card_set_code), lower(regexp_extract(collector_number, '^(\\D*)(\\d*)', 1)), try_cast(regexp_extract(collector_number, '^(\\D*)(\\d*)', 2) AS BIGINT), lower(regexp_extract(collector_number, '^(\\D*)(\\d*)(.*)$', 3))", "low"),
    "tix": ("NULL", "low"), "toughness": ("NULL", "low"), "usd": ("price_usd", "low"),
}


def _split(keys: str) -> list[str]:
    out, depth, at = [""], 0, False
    for c in keys:
        at ^= c == "'"
        depth += 0 if at else (c == "(") - (c == ")")
        if c == "," and depth == 0 and not at:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def _order_sql(orderby: str, direction: str) -> str:
    keys, side = _ORDER_SQL[orderby]
    down = direction == "desc" or direction == "auto" and orderby in ("released", "rarity", "usd", "tix", "eur")
    nulls = ("LAST" if down else "FIRST") if side == "low" else ("FIRST" if down else "LAST")
    named = [f"{k} {'DESC' if down else 'ASC'} NULLS {nulls}" for k in _split(keys) if k != "NULL"]
    return ", ".join([*named, "name_key ASC NULLS LAST", "is_canonical DESC", "CASE WHEN NOT is_canonical THEN lower(card_lang) END ASC NULLS FIRST", "scryfall_id ASC"])


def _paged(query: str, where: str, unique: str, prefer: str, orderby: str, direction: str, limit: int, offset: int, multilingual: bool = False):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = search(corpus(spark, d), query, unique=unique, prefer=prefer, orderby=orderby, direction=direction, limit=limit, offset=offset, include_multilingual=multilingual).rows
        return rows.select(F.col("position").cast("bigint").alias("position"), "scryfall_id", "card_name")

    run.__doc__ = f"Rows {offset} to {offset + limit} of {query!r}, unique by {unique}, preferring {prefer}, ordered by {orderby} {direction}."
    lane = f"({where}) AND NOT is_extra" + ("" if multilingual else " AND is_canonical")
    numbered = f"SELECT row_number() OVER (ORDER BY {_order_sql(orderby, direction)}) - 1 AS position, scryfall_id, card_name FROM ({_choice_sql(lane, unique, prefer)})"
    return run, _sql(f"SELECT * FROM ({numbered}) WHERE position >= {offset} AND position < {offset + limit}")


def _whole(query: str, where: str, unique: str, prefer: str, multilingual: bool = False):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return search(corpus(spark, d), query, unique=unique, prefer=prefer, limit=None, include_multilingual=multilingual).matches.select("scryfall_id", "card_name")

    run.__doc__ = f"All results of {query!r}, unique by {unique}, preferring {prefer}."
    lane = f"({where}) AND NOT is_extra" + ("" if multilingual else " AND is_canonical")
    return run, _sql(f"SELECT scryfall_id, card_name FROM ({_choice_sql(lane, unique, prefer)})")


_CREATURES = ("t:creature cmc<=4", "lower(type_line) LIKE '%creature%' AND cmc <= 4")
_PAGES = {f"ord_{o}_{way}": _paged(*_CREATURES, "card", "default", o, way, 40, 10) for o in ("artist", "cmc", "color", "edhrec", "eur", "name", "rarity", "released", "set", "usd") for way in ("asc", "desc")}
_PAGES |= {f"ord_{o}_auto": _paged(*_CREATURES, "printing", "default", o, "auto", 60, 0) for o in ("released", "name")}
_PAGES |= {f"unq_{u}_{'all' if m else 'en'}": _whole(*_CREATURES, u, "default", m) for u in ("card", "printing", "artwork") for m in (False, True)}
_PAGES |= {f"prf_{p}": _whole(*_CREATURES, "card", p) for p in ("oldest", "newest", "usd_low", "usd_high")}
_PAGES |= {f"lim_page_{n}": _paged("r>=rare", "card_rarity_int >= 2", "printing", "default", "name", "auto", PAGE, (n - 1) * PAGE) for n in (1, 2, 3)}


def _query(f):
    QUERIES[f.__name__] = f
    return f


QUERIES = {name: _filter(q) for name, (q, _) in FILTERS.items()} | {name: q for name, (q, _) in _PAGES.items()}
SQL = {name: _sql(f"SELECT scryfall_id, card_name FROM cur WHERE {where}") for name, (_, where) in FILTERS.items()} | {name: s for name, (_, s) in _PAGES.items()}


@_query
def par_directive_unique(spark: SparkSession, d: str) -> DataFrame:
    """Directives in the query go before the options: here, artworks by their newest printing."""
    return search(corpus(spark, d), "t:land unique:art prefer:newest", **_ALL).matches.select("scryfall_id", "card_name")


SQL["par_directive_unique"] = _sql(f"SELECT scryfall_id, card_name FROM ({_choice_sql("lower(type_line) LIKE '%land%'", 'artwork', 'newest')})")


@_query
def gate_default_lane(spark: SparkSession, d: str) -> DataFrame:
    """What a plain query leaves out: extras, variants and other languages."""
    return search(corpus(spark, d), "t:creature", unique="printing", limit=None).matches.select("scryfall_id")


SQL["gate_default_lane"] = _sql("SELECT scryfall_id FROM cur WHERE lower(type_line) LIKE '%creature%' AND NOT is_extra AND is_canonical")


@_query
def gate_asked_for_extras(spark: SparkSession, d: str) -> DataFrame:
    """A query that names tokens gets them, and one that names a language gets its rows."""
    return search(corpus(spark, d), "t:token lang:de", unique="printing", limit=None).matches.select("scryfall_id")


SQL["gate_asked_for_extras"] = _sql("SELECT scryfall_id FROM cur WHERE lower(type_line) LIKE '%token%' AND lower(card_lang) = 'de'")


@_query
def agg_total_cards(spark: SparkSession, d: str) -> DataFrame:
    """The total of a paged search: matching cards, however many a page shows."""
    return search(corpus(spark, d), "cmc>=2", include_extras=True).matches.agg(F.count("*").alias("total_cards"))


SQL["agg_total_cards"] = _sql("SELECT count(DISTINCT coalesce(oracle_id, 'row ' || scryfall_id)) AS total_cards FROM cur WHERE cmc >= 2 AND is_canonical")


@_query
def agg_type_counts(spark: SparkSession, d: str) -> DataFrame:
    """Cards per type."""
    return counts.type_counts(corpus(spark, d))


SQL["agg_type_counts"] = _sql(
    "SELECT type, n_cards FROM n UNION ALL SELECT 'Tribal', n_cards FROM n WHERE type = 'Kindred'",
    "t AS (SELECT oracle_id, unnest(list_filter(regexp_split_to_array(split_part(type_line, '—', 1), '\\s+'), lambda x: length(x) > 0)) AS type FROM cur WHERE is_canonical), n AS (SELECT type, count(DISTINCT oracle_id) AS n_cards FROM t GROUP BY 1)",
)


@_query
def agg_keyword_counts(spark: SparkSession, d: str) -> DataFrame:
    """Cards per keyword."""
    return counts.keyword_counts(corpus(spark, d))


SQL["agg_keyword_counts"] = _sql("SELECT keyword, count(DISTINCT oracle_id) AS n_cards FROM (SELECT oracle_id, lower(unnest(card_keywords)) AS keyword FROM cur WHERE is_canonical) WHERE keyword IS NOT NULL GROUP BY 1")


@_query
def agg_sets_with_extras(spark: SparkSession, d: str) -> DataFrame:
    """Sets that hold extra rows."""
    return counts.sets_with_extras(corpus(spark, d))


SQL["agg_sets_with_extras"] = _sql("SELECT DISTINCT lower(card_set_code) AS set_code FROM cur WHERE is_extra")


@_query
def agg_totals(spark: SparkSession, d: str) -> DataFrame:
    """Cards and printings in all."""
    return counts.totals(corpus(spark, d))


SQL["agg_totals"] = _sql("SELECT count(DISTINCT oracle_id) AS n_cards, count(*) AS n_printings, count(*) FILTER (is_canonical) AS n_canonical FROM cur")


@_query
def agg_illustration_counts(spark: SparkSession, d: str) -> DataFrame:
    """Printings per artwork and name."""
    return counts.illustration_counts(corpus(spark, d))


SQL["agg_illustration_counts"] = _sql("SELECT illustration_id, card_name, count(*) AS illustration_count FROM cur WHERE lower(card_lang) = 'en' AND coalesce(lower(set_type), '') <> 'memorabilia' AND coalesce(lower(card_border), '') NOT IN ('gold', 'yellow') AND illustration_id IS NOT NULL GROUP BY 1, 2")


@_query
def agg_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """The latest delivery of every printing."""
    return current(table(spark, d, "printings"), ["imported_at", "row_no"]).select("scryfall_id", "row_no")


SQL["agg_last_wins"] = _sql("SELECT lower(trim(scryfall_id)) AS scryfall_id, row_no FROM latest WHERE newest = 1")


@_query
def agg_distinct_artists(spark: SparkSession, d: str) -> DataFrame:
    """The artists' names."""
    return counts.distinct_values(corpus(spark, d), "card_artist")


SQL["agg_distinct_artists"] = _sql("SELECT DISTINCT card_artist AS value FROM cur WHERE card_artist <> ''")


@_query
def der_unique(spark: SparkSession, d: str) -> DataFrame:
    """Printings of cards that were printed in one set only."""
    return search(with_unique_tag(corpus(spark, d)), "is:unique", **_ALL).matches.select("scryfall_id")


SQL["der_unique"] = _sql("SELECT scryfall_id FROM cur WHERE oracle_id IN (SELECT oracle_id FROM cur GROUP BY 1 HAVING count(DISTINCT lower(card_set_code)) = 1)")


@_query
def win_percent_rank(spark: SparkSession, d: str) -> DataFrame:
    """Every name's percent rank by play rank, times 25."""
    from quillon.operators.ranks import name_percent_ranks

    return name_percent_ranks(corpus(spark, d), "card_name", "edhrec_rank", "row_no").select("card_name", F.round("score", 6).alias("score"))


SQL["win_percent_rank"] = _sql("SELECT card_name, round(25 * percent_rank() OVER (ORDER BY edhrec_rank ASC NULLS LAST), 6) AS score FROM (SELECT card_name, first(edhrec_rank ORDER BY row_no) AS edhrec_rank FROM cur WHERE card_name IS NOT NULL GROUP BY 1)")


@_query
def win_printing_rank(spark: SparkSession, d: str) -> DataFrame:
    """Every printing slot's place within its card: English first, plain numbers first, newest first."""
    from quillon.operators.ranks import slot_ranks

    return slot_ranks(corpus(spark, d)).select("oracle_id", "set_code", "collector_number", "rank")


SQL["win_printing_rank"] = _sql(
    """SELECT oracle_id, set_code, collector_number, CAST(least(row_number() OVER (PARTITION BY oracle_id ORDER BY english DESC, prefixed ASC, released DESC NULLS LAST,
       prefix ASC, number ASC NULLS FIRST, suffix ASC, set_code ASC, collector_number ASC) - 1, 1024) AS INTEGER) AS rank FROM slot""",
    """slot AS (SELECT oracle_id, lower(card_set_code) AS set_code, collector_number, max(try_cast(released_at AS DATE)) AS released, bool_or(coalesce(lower(card_lang) = 'en', false)) AS english,
       lower(regexp_extract(collector_number, '^(\\D*)(\\d*)(.*)$', 1)) AS prefix, regexp_matches(lower(regexp_extract(collector_number, '^(\\D*)(\\d*)(.*)$', 1)), '[a-z]') AS prefixed,
       try_cast(regexp_extract(collector_number, '^(\\D*)(\\d*)(.*)$', 2) AS BIGINT) AS number, lower(regexp_extract(collector_number, '^(\\D*)(\\d*)(.*)$', 3)) AS suffix
       FROM cur WHERE oracle_id IS NOT NULL AND card_set_code IS NOT NULL AND collector_number IS NOT NULL GROUP BY ALL)""",
)


@_query
def smp_random(spark: SparkSession, d: str) -> DataFrame:
    """Twenty-five cards drawn at random."""
    return sample(corpus(spark, d), "t:creature", 25, seed=7).select("scryfall_id", "card_name")


@_query
def nam_exact_many(spark: SparkSession, d: str) -> DataFrame:
    """The card of every name that a ruling could quote: here, all names of the catalogue, each looked up."""
    c = corpus(spark, d)
    return lookup.exact_many(c, c.select(F.col("card_name").alias("name")).where("name is not null")).select("name", "scryfall_id")


SQL["nam_exact_many"] = _sql(
    "SELECT name, scryfall_id FROM (SELECT a.name, k.scryfall_id, row_number() OVER (PARTITION BY a.name ORDER BY tier DESC, is_canonical DESC, score DESC NULLS LAST, k.scryfall_id) AS best FROM asked a JOIN keyed k ON a.key = k.key) WHERE best = 1",
    """asked AS (SELECT DISTINCT card_name AS name, name_key AS key FROM cur WHERE name_key <> ''),
       keyed AS (SELECT scryfall_id, is_canonical, CASE WHEN NOT isnan(prefer_score) THEN prefer_score END AS score, name_key AS key, 2 AS tier FROM cur
         UNION ALL SELECT scryfall_id, is_canonical, CASE WHEN NOT isnan(prefer_score) THEN prefer_score END, regexp_replace(lower(strip_accents(unnest(list_transform(card_faces, lambda f: f.name)))), '[^\\p{L}\\p{N}]+', '', 'g'), 1 FROM cur)""",
)


@_query
def nam_containing(spark: SparkSession, d: str) -> DataFrame:
    """One card per name that contains both words."""
    return lookup.containing(corpus(spark, d), "lantern of").select("card_name", "scryfall_id")


SQL["nam_containing"] = _sql(f"SELECT card_name, scryfall_id FROM (SELECT *, row_number() OVER (PARTITION BY name_key ORDER BY {_SCORE}) AS best FROM cur WHERE is_canonical AND name_key LIKE '%lantern%' AND name_key LIKE '%of%') WHERE best = 1")


@_query
def nam_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """The name most like a misspelt one."""
    return lookup.fuzzy(corpus(spark, d), "Nirnen Bassin").select("card_name", "ambiguous")


_GRAMS = lambda x: f"list_distinct(list_transform(range(1, length({x}) + 2), lambda i: ('  ' || {x} || ' ')[i:i + 2]))"
_LIKE = lambda a, b: f"len(list_intersect({_GRAMS(a)}, {_GRAMS(b)})) / len(list_distinct(list_concat({_GRAMS(a)}, {_GRAMS(b)})))"
_ONE_NAME = f"one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name_key ORDER BY {_SCORE}) AS best FROM cur WHERE is_canonical AND name_key <> '') WHERE best = 1)"
SQL["nam_fuzzy"] = _sql(
    "SELECT b.card_name, coalesce(b.similarity - (SELECT max(similarity) FROM hit WHERE card <> b.card) < 0.002, false) AS ambiguous FROM (SELECT * FROM hit ORDER BY similarity DESC, name_key LIMIT 1) b",
    f"{_ONE_NAME}, hit AS (SELECT * FROM (SELECT *, coalesce(oracle_id, 'row ' || scryfall_id) AS card, {_LIKE('name_key', chr(39) + 'nirnenbassin' + chr(39))} AS similarity FROM one) WHERE similarity >= 0.625)",
)


@_query
def nam_autocomplete(spark: SparkSession, d: str) -> DataFrame:
    """Names that go on from a beginning."""
    return lookup.autocomplete(corpus(spark, d), "war").select("card_name", F.col("position").cast("bigint").alias("position"))


SQL["nam_autocomplete"] = _sql(
    "SELECT card_name, row_number() OVER (ORDER BY starts DESC, similarity DESC, name_key) - 1 AS position FROM hit QUALIFY row_number() OVER (ORDER BY starts DESC, similarity DESC, name_key) <= 20",
    f"""names AS (SELECT name_key, min(card_name) AS card_name FROM cur WHERE is_canonical AND NOT is_extra GROUP BY 1),
        hit AS (SELECT *, starts_with(name_key, 'war') AS starts, round({_LIKE('name_key', chr(39) + 'war' + chr(39))}, 9) AS similarity FROM names WHERE name_key LIKE '%war%')""",
)


@_query
def jn_collection(spark: SparkSession, d: str) -> DataFrame:
    """A list of every hundredth printing by set and number, in the list's order."""
    c = corpus(spark, d)
    asked = table(spark, d, "printings").where("row_no % 100 = 0").select(F.col("row_no").alias("position"), F.col("card_set_code").alias("set"), "collector_number").where("set is not null and collector_number is not null")
    found, _ = lookup.collection(c, asked)
    return found.select("position", "scryfall_id")


SQL["jn_collection"] = _sql(f"SELECT position, scryfall_id FROM (SELECT p.row_no AS position, c.scryfall_id, row_number() OVER (PARTITION BY p.row_no ORDER BY c.is_canonical DESC, CASE WHEN NOT isnan(c.prefer_score) THEN c.prefer_score END DESC NULLS LAST, c.scryfall_id) AS best FROM printings p JOIN cur c ON lower(p.card_set_code) = lower(c.card_set_code) AND p.collector_number = c.collector_number WHERE p.row_no % 100 = 0) WHERE best = 1")


@_query
def rul_rulings(spark: SparkSession, d: str) -> DataFrame:
    """Whole rulings, repeated ones once, numbered within their card: newest first, then by comment."""
    from quillon.operators.rulings import clean_rulings, numbered

    return numbered(clean_rulings(table(spark, d, "rulings"))).select("oracle_id", "source", "published_at", "comment", "place")


SQL["rul_rulings"] = """
    SELECT *, CAST(row_number() OVER (PARTITION BY oracle_id ORDER BY published_at DESC, comment ASC, source ASC) AS INTEGER) AS place FROM (
        SELECT DISTINCT lower(trim(oracle_id)) AS oracle_id, source, left(published_at, 10) AS published_at, comment FROM rulings
        WHERE trim(oracle_id) <> '' AND source <> '' AND length(published_at) >= 10 AND comment <> '')"""
