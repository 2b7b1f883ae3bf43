"""Queries over the catalogue that is built from raw records, with rules texts, faces and tags; their SQL starts from the
raw JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.catalogs import CATALOGS, catalog, set_list, symbology
from quillon.operators.lookup import collection, set_of
from quillon.operators.prepare import prepare, with_card_facts
from quillon.operators.search import search
from quillon.operators.store import store
from quillon.operators.transform import EXTRA_LAYOUTS, FUNNY_EXTRA_SETS, finalize, tag_aliases
from quillon.pipeline_queries import _TAG_CTE, _WHOLE, rows
from quillon.search_queries import _ALL, corpus
from quillon.search_queries import _sql as printings_sql
from quillon.runtime import collect_garbage, drop, materialise, tidied
from quillon.sinks.render import card_object
from quillon.sources.tables import table


def rules_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The prepared rows of a folder's raw records, kept for all queries of the session."""

    def build() -> DataFrame:
        with tidied(spark):
            final = finalize(rows(spark, d), table(spark, d, "tags"), kept=(read := []))
            collect_garbage(spark)  # the plan that follows is the largest
            prepared, path = materialise(prepare(final), "prepared")
            for old in read:
                drop(spark, old)
            spare.append(path)
            return with_card_facts(prepared, "artist_ids")

    spare: list[str] = []
    kept = store(spark, [f"{d.rstrip('/')}/{t}.parquet" for t in ("bulk_lines", "tags")], build)
    for path in spare:
        drop(spark, path)
    if spare:
        collect_garbage(spark)
    return kept


def _j(key: str, of: str = "line") -> str:
    return f"json_extract_string({of}, '$.{key}')"


def _list(key: str, of: str = "line") -> str:
    return f"coalesce(CAST(json_extract_string({of}, '$.{key}[*]') AS VARCHAR[]), [])"


def _mask(colors: str) -> str:
    return f"coalesce(list_sum(list_transform(list_distinct({colors}), lambda x: CASE x WHEN 'W' THEN 1 WHEN 'U' THEN 2 WHEN 'B' THEN 4 WHEN 'R' THEN 8 WHEN 'G' THEN 16 ELSE 0 END)), 0)"


def _of_faces(key: str) -> str:
    own = f"CASE WHEN json_exists(f, '$.{key}') THEN {_j(key, 'f')} ELSE {_j(key)} END"
    return f"CASE WHEN len(faces) > 0 THEN list_transform(faces, lambda f: {own}) ELSE [{_j(key)}] END"


#: A face without colours has those of the row, which unites what its faces have or take from the record.
_MERGED = f"flatten(list_transform(faces, lambda g: CASE WHEN json_exists(g, '$.colors') THEN {_list('colors', 'g')} ELSE {_list('colors')} END))"
_NUMBER = "^([^0-9]*)([0-9]*)(.*)$"
_TYPES = "list_filter(regexp_split_to_array(split_part(t, '—', 1), '\\s+'), lambda w: length(w) > 0)"
#: ``cur``: a row a printing, from its last line; ``fin``: with tags, ranks and scores.
_RECORDS = f"""
    whole AS (SELECT *, lower(trim({_j('id')})) AS scryfall_id, row_number() OVER (PARTITION BY lower(trim({_j('id')})) ORDER BY line_no DESC) AS newest FROM bulk_lines WHERE {_WHOLE} AND trim({_j('id')}) <> ''),
    faced AS (SELECT *, CASE WHEN json_type(json_extract(line, '$.card_faces')) = 'ARRAY' THEN json_extract(line, '$.card_faces[*]') ELSE [] END AS faces FROM whole WHERE newest = 1),
    cur AS (
        SELECT *, nullif(lower(trim({_j('oracle_id')})), '') AS oracle_id, {_j('name')} AS card_name, lower({_j('lang')}) AS lang, lower({_j('set')}) AS set_code, lower({_j('set_type')}) AS set_type, lower({_j('border_color')}) AS border,
               lower({_j('layout')}) AS layout, {_j('collector_number')} AS number, try_cast({_j('released_at')} AS DATE) AS released, try_cast({_j('cmc')} AS DOUBLE) AS cmc, try_cast(try_cast({_j('edhrec_rank')} AS DOUBLE) AS BIGINT) AS edhrec,
               nullif(lower(trim({_j('illustration_id')})), '') AS illustration_id, lower({_j('rarity')}) AS rarity, {_j('frame')} AS frame,
               array_to_string(list_filter({_of_faces('oracle_text')}, lambda x: length(x) > 0), chr(10) || '//' || chr(10)) AS rules, array_to_string(list_filter({_of_faces('type_line')}, lambda x: length(x) > 0), ' // ') AS type_line,
               list_transform({_of_faces('type_line')}, lambda t: {_TYPES}) AS face_types, {_of_faces('oracle_text')} AS face_rules, {_of_faces('mana_cost')} AS face_costs, coalesce(array_to_string(list_filter({_of_faces('flavor_text')}, lambda x: length(x) > 0), chr(10) || '//' || chr(10)), '') AS flavor,
               {_list('colors')} AS colors, {_list('color_identity')} AS ident, {_list('keywords')} AS keywords, {_list('finishes')} AS finishes, {_list('games')} AS games,
               CASE WHEN len(list_filter(faces, lambda f: json_exists(f, '$.colors'))) > 0 THEN list_transform(faces, lambda f: {_mask(f"CASE WHEN json_exists(f, '$.colors') THEN {_list('colors', 'f')} ELSE {_MERGED} END")}) ELSE [{_mask(_list('colors'))}] END AS face_masks,
               lower(regexp_replace(array_to_string(list_filter({_of_faces('oracle_text')}, lambda x: length(x) > 0), chr(10) || '//' || chr(10)), '\\([^)]*\\)', '', 'g')) AS bare,
               regexp_replace(lower(strip_accents({_j('name')})), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS name_key,
               coalesce(lower({_j('set_type')}) = 'funny' AND lower({_j('set')}) IN {FUNNY_EXTRA_SETS}, false) OR coalesce({_j('border_color')} = 'silver' AND {_j('set_type')} = 'promo', false)
                 OR coalesce({_j('layout')} IN {EXTRA_LAYOUTS}, false) OR coalesce({_j('set_type')} = 'memorabilia', false)
                 OR coalesce(list_has_any(flatten(list_transform([{_j('type_line')}], lambda t: {_TYPES})), ['Card', 'Token']), false) AS is_extra
        FROM faced)"""
_FINAL = f"""
    {_TAG_CTE},
    tagged AS (SELECT DISTINCT id, nullif(lower(trim(t.oracle_id)), '') AS oracle_id, nullif(lower(trim(t.illustration_id)), '') AS illustration_id FROM (SELECT id, unnest(taggings) AS t FROM tag WHERE slug <> '')),
    otag AS (SELECT g.oracle_id, list_sort(list(DISTINCT u.slug)) AS otags FROM tagged g JOIN walk w USING (id) JOIN tag u ON u.id = w.up WHERE g.oracle_id IS NOT NULL AND u.slug <> '' GROUP BY 1),
    atag AS (SELECT g.illustration_id, list_sort(list(DISTINCT u.slug)) AS atags FROM tagged g JOIN walk w USING (id) JOIN tag u ON u.id = w.up WHERE g.illustration_id IS NOT NULL AND u.slug <> '' GROUP BY 1),
    {_RECORDS},
    art AS (SELECT illustration_id, card_name, count(*) AS n FROM cur WHERE lang = 'en' AND coalesce(set_type, '') <> 'memorabilia' AND coalesce(border, '') NOT IN ('gold', 'yellow') AND illustration_id IS NOT NULL GROUP BY 1, 2),
    named AS (SELECT card_name, 25 * percent_rank() OVER (ORDER BY edhrec ASC NULLS LAST) AS pr FROM (SELECT card_name, first(edhrec ORDER BY line_no) AS edhrec FROM cur GROUP BY 1)),
    slot AS (SELECT oracle_id, set_code, number, max(released) AS released, bool_or(coalesce(lang = 'en', false)) AS english, lower(regexp_extract(number, '{_NUMBER}', 1)) AS prefix, try_cast(regexp_extract(number, '{_NUMBER}', 2) AS BIGINT) AS digits, lower(regexp_extract(number, '{_NUMBER}', 3)) AS suffix FROM cur WHERE oracle_id IS NOT NULL AND set_code IS NOT NULL AND number IS NOT NULL GROUP BY ALL),
    placed AS (SELECT oracle_id, set_code, number, least(row_number() OVER (PARTITION BY oracle_id ORDER BY english DESC, regexp_matches(prefix, '[a-z]') ASC, released DESC NULLS LAST, prefix ASC, digits ASC NULLS FIRST, suffix ASC, set_code ASC, number ASC) - 1, 1024) AS rank FROM slot),
    fin AS (
        SELECT c.*, coalesce(o.otags, []) AS otags, coalesce(a.atags, []) AS atags, coalesce(art.n, 0) AS illustration_count, CAST(n.pr AS FLOAT) AS cubecobra,
               (1024 - coalesce(p.rank, 1024)) * 2048.0 + round(CAST(23.0 * ln(1 + coalesce(art.n, 0)) / ln(40.0) AS DOUBLE), 4) + CASE WHEN rarity IN ('common', 'uncommon') THEN 16 WHEN rarity = 'rare' THEN 11 ELSE 0 END + CASE WHEN border = 'black' THEN 14 ELSE 0 END
               + CASE frame WHEN '2015' THEN 42 WHEN '2003' THEN 30 WHEN '1997' THEN 25 WHEN '1993' THEN 10 ELSE 0 END + CASE WHEN list_contains(games, 'paper') THEN 6 ELSE 0 END + CASE WHEN lang = 'en' THEN 40 ELSE 0 END + 10
               + CASE WHEN list_contains(finishes, 'nonfoil') THEN 10 WHEN list_contains(finishes, 'foil') THEN 5 ELSE 0 END + CASE WHEN c.set_code = 'dbl' THEN 0 ELSE 20 END
               + CASE WHEN (list_contains(coalesce(a.atags, []), 'external-ip') AND NOT list_has_any(coalesce(a.atags, []), ['dungeons-and-dragons', 'the-lord-of-the-rings'])) OR list_has_any(coalesce(a.atags, []), ['anime', 'comic-style', 'line-art', 'word-art-title']) THEN 0 ELSE 14 END AS score
        FROM cur c LEFT JOIN otag o USING (oracle_id) LEFT JOIN atag a ON a.illustration_id = c.illustration_id LEFT JOIN art ON art.illustration_id = c.illustration_id AND art.card_name = c.card_name
             LEFT JOIN named n ON n.card_name = c.card_name LEFT JOIN placed p ON p.oracle_id = c.oracle_id AND p.set_code = c.set_code AND p.number = c.number)"""


def _sql(select: str, more: str = "") -> str:
    return f"WITH RECURSIVE {_FINAL}{', ' + more if more else ''} {select}"


_ALIASES = "SELECT alias, min(slug) AS slug FROM (SELECT slug, trim(regexp_replace(lower(a), '[^a-z0-9]+', '-', 'g'), '-') AS alias FROM (SELECT slug, unnest(aliases) AS a FROM tag WHERE slug <> '')) WHERE alias <> '' AND alias NOT IN (SELECT slug FROM tag WHERE slug <> '') GROUP BY 1 HAVING count(DISTINCT slug) = 1"
_PERMANENT = "regexp_matches(lower(type_line), 'creature|artifact|enchantment|land|planeswalker|battle')"
_IDENT = _mask("ident")
_GENERIC = "coalesce(try_cast(regexp_extract(x, '\\{([0-9]+)\\}', 1) AS INTEGER), 0)"
_R = "(length(x) - length(replace(x, '{R}', ''))) / 3"
#: name -> (query, what SQL says of a matching row)
FILTERS: dict[str, tuple[str, str]] = {
    "rtx_all": ("", "true"),
    "rtx_oracle": ("o:\"to make room\"", "bare LIKE '%to make room%'"),
    "rtx_oracle_not": ("-o:graveyard", "NOT coalesce(bare LIKE '%graveyard%', false)"),
    "rtx_full_oracle": ("fo:\"during your own turn\"", "lower(rules) LIKE '%during your own turn%'"),
    "rtx_oracle_regex": ("o:/second (game|season)/", "regexp_matches(bare, 'second (game|season)')"),
    "rtx_flavor": ("ft:season", "lower(flavor) LIKE '%season%'"),
    "rtx_has_flavor": ("has:flavor", "length(flavor) > 0"),
    "rtx_identity": ("id:wu", f"{_IDENT} & 3 = {_IDENT}"),
    "rtx_identity_exact": ("id=bg", f"{_IDENT} = 20"),
    "rtx_identity_count": ("ci>=3", f"bit_count(CAST({_IDENT} AS INTEGER)) >= 3"),
    "rtx_identity_name": ("commander:esper", f"{_IDENT} & 7 = {_IDENT}"),
    "rtx_frame": ("frame:2015", "frame = '2015'"),
    "rtx_frame_old": ("frame:old", "frame IN ('1993', '1997')"),
    "rtx_is_new": ("is:new", "frame IN ('2003', '2015', 'future')"),
    "rtx_extra": ("is:extra", "is_extra"),
    "rtx_funny": ("is:funny", "set_type = 'funny'"),
    "rtx_vanilla": ("is:vanilla", "lower(type_line) LIKE '%creature%' AND NOT lower(type_line) LIKE '%land%' AND trim(regexp_replace(coalesce(face_rules[1], ''), '\\([^)]*\\)', '', 'g')) = ''"),
    "rtx_otag": ("otag:burning-bridge-157 or otag:quiet-curse-13 or function:twin-orchard-34", "list_has_any(otags, ['burning-bridge-157', 'quiet-curse-13', 'twin-orchard-34'])"),
    "rtx_otag_alias": ("otag:\"Alt Painted Ramp 133\" or otag:alt-painted-flame-9", f"list_has_any(otags, (SELECT list(slug) FROM ({_ALIASES}) WHERE alias IN ('alt-painted-ramp-133', 'alt-painted-flame-9')))"),
    "rtx_otag_regex": ("otag:/^burning/", "len(list_filter(otags, lambda t: regexp_matches(t, '^burning'))) > 0"),
    "rtx_atag_regex": ("art:/bird|sky/", "len(list_filter(atags, lambda t: regexp_matches(t, 'bird|sky'))) > 0"),
    "rtx_color_faces": ("c:u", "len(list_filter(face_masks, lambda m: CAST(m AS INTEGER) & 2 = 2)) > 0"),
    "rtx_color_faces_exact": ("c=r", "len(list_filter(face_masks, lambda m: m = 8)) > 0"),
    "rtx_cost_faces": ("m:{1}{R}", f"len(list_filter(face_costs, lambda x: length(x) > 0 AND {_R} >= 1 AND {_GENERIC} >= 1)) > 0"),
    "rtx_devotion": ("devotion:{r}", f"{_PERMANENT} AND length(regexp_replace(coalesce(face_costs[1], ''), '[^R]', '', 'g')) >= 1"),
    "rtx_type_faces": ("t:\"creature — heron\" or t:moth", "lower(type_line) LIKE '%creature — heron%' OR lower(type_line) LIKE '%moth%'"),
    "rtx_keyword": ("kw:thornskin -kw:hover", "list_contains(list_transform(keywords, lambda k: lower(k)), 'thornskin') AND NOT list_contains(list_transform(keywords, lambda k: lower(k)), 'hover')"),
    "rtx_layout": ("layout:modal_dfc", "layout = 'modal_dfc'"),
    "rtx_price": ("usd>5", f"coalesce(try_cast({_j('prices.usd')} AS DOUBLE), try_cast({_j('prices.usd_foil')} AS DOUBLE), try_cast({_j('prices.usd_etched')} AS DOUBLE)) > 5"),
    "rtx_format": ("banned:modern or f:commander", f"{_j('legalities.modern')} = 'banned' OR {_j('legalities.commander')} IN ('legal', 'restricted')"),
    "rtx_unique": ("is:unique", "oracle_id IN (SELECT oracle_id FROM fin GROUP BY 1 HAVING count(DISTINCT set_code) = 1)"),
    "rtx_mixed": ("(o:turn or ft:turn) id<=3 -is:extra", f"(bare LIKE '%turn%' OR lower(flavor) LIKE '%turn%') AND bit_count(CAST({_IDENT} AS INTEGER)) <= 3 AND NOT is_extra"),
}

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _filter(query: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        options = {"aliases": tag_aliases(table(spark, d, "tags"))} if "otag" in query else {}
        return search(rules_corpus(spark, d), query, **_ALL, **options).matches.select("scryfall_id", "card_name")

    run.__doc__ = f"All printings of the raw records that match {query!r}."
    return run


QUERIES |= {name: _filter(q) for name, (q, _) in FILTERS.items()}
SQL |= {name: _sql(f"SELECT scryfall_id, card_name FROM fin WHERE {where}") for name, (_, where) in FILTERS.items()}


def _ordered(query: str, where: str, orderby: str, keys: str, unique: str = "printing"):
    def run(spark: SparkSession, d: str) -> DataFrame:
        page = search(rules_corpus(spark, d), query, unique=unique, orderby=orderby, limit=50, offset=5, include_extras=True, include_multilingual=True).rows
        return page.select(F.col("position").cast("bigint").alias("position"), "scryfall_id")

    run.__doc__ = f"Rows 5 to 55 of {query!r} by {orderby}, unique by {unique}."
    chosen = "fin" if unique == "printing" else "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY oracle_id ORDER BY CAST(score AS FLOAT) DESC, scryfall_id) AS choice FROM fin WHERE " + where + ") WHERE choice = 1)"
    return run, _sql(f"SELECT * FROM (SELECT row_number() OVER (ORDER BY {keys}, name_key ASC NULLS LAST, scryfall_id) - 1 AS position, scryfall_id FROM {chosen} WHERE {where}) WHERE position >= 5 AND position < 55")


QUERIES["rtx_ord_cubecobra"], SQL["rtx_ord_cubecobra"] = _ordered("cmc>=2", "cmc >= 2", "cubecobra", "cubecobra ASC NULLS FIRST")
QUERIES["rtx_card_cmc"], SQL["rtx_card_cmc"] = _ordered("t:creature", "lower(type_line) LIKE '%creature%'", "cmc", "cmc ASC NULLS FIRST", "card")


@_query
def rtx_gate(spark: SparkSession, d: str) -> DataFrame:
    """A query that names a set with extras gets them; one for a type does not."""
    found = search(rules_corpus(spark, d), "e:mh7 or e:pbp or e:f8g or e:m3m", unique="printing", limit=None, include_multilingual=True)
    return found.matches.select("scryfall_id")


SQL["rtx_gate"] = _sql("SELECT scryfall_id FROM fin WHERE set_code IN ('mh7', 'pbp', 'f8g', 'm3m') AND (NOT is_extra OR EXISTS (SELECT 1 FROM fin x WHERE x.is_extra AND x.set_code IN ('mh7', 'pbp', 'f8g', 'm3m')))")


@_query
def prj_final_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the raw records with tags, ranks and scores."""
    final = finalize(rows(spark, d), table(spark, d, "tags"))
    return final.select("line_no", "scryfall_id", "illustration_count", F.round("cubecobra_score", 3).alias("cubecobra_score"), F.round("prefer_score", 2).alias("prefer_score"), F.size("card_oracle_tags").alias("n_tags"))


SQL["prj_final_rows"] = _sql("SELECT line_no, scryfall_id, illustration_count, round(cubecobra, 3) AS cubecobra_score, round(CAST(score AS FLOAT), 2) AS prefer_score, CAST(len(otags) AS INTEGER) AS n_tags FROM fin")


@_query
def prj_residue(spark: SparkSession, d: str) -> DataFrame:
    """How many records keep each key that no column holds."""
    return rows(spark, d).select(F.explode(F.map_keys("residue")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


SQL["prj_residue"] = f"SELECT key, count(*) AS n FROM (SELECT DISTINCT line_no, unnest(json_keys(line)) AS key FROM bulk_lines WHERE {_WHOLE}) WHERE key IN ('object', 'all_parts') GROUP BY 1"


@_query
def snk_objects(spark: SparkSession, d: str) -> DataFrame:
    """Some members of every printing's JSON object, read back from it."""
    objects = rules_corpus(spark, d).select("scryfall_id", card_object().alias("o"))
    member = lambda path: F.get_json_object("o", path)
    return objects.select(
        "scryfall_id", member("$.name").alias("name"), member("$.set").alias("set"), member("$.rarity").alias("rarity"), member("$.mana_cost").alias("mana_cost"), member("$.prices.usd_foil").alias("usd_foil"),
        member("$.type_line").alias("type_line"), member("$.card_faces[1].name").alias("back"), member("$.uri").alias("uri"),
    )


SQL["snk_objects"] = _sql(
    """SELECT scryfall_id, card_name AS name, set_code AS set, rarity, CASE WHEN len(faces) > 0 AND layout NOT IN ('art_series', 'double_faced_token', 'modal_dfc', 'reversible_card', 'transform') THEN array_to_string(list_filter(face_costs, lambda x: length(x) > 0), ' // ') END AS mana_cost,
       CAST(CAST(try_cast(json_extract_string(line, '$.prices.usd_foil') AS DOUBLE) AS DECIMAL(12, 2)) AS VARCHAR) AS usd_foil, CASE WHEN layout <> 'reversible_card' THEN type_line END AS type_line, json_extract_string(line, '$.card_faces[1].name') AS back, '/cards/' || scryfall_id AS uri FROM fin"""
)


@_query
def jn_collection_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Every hundredth printing asked for by each kind of identifier in turn, those that name none included."""
    asked = table(spark, d, "printings").where("row_no % 100 = 0")
    turn = lambda n, c: F.when(F.floor(F.col("row_no") / 100) % 5 == n, F.col(c))
    asked = asked.select(F.col("row_no").alias("position"), turn(0, "scryfall_id").alias("id"), turn(1, "oracle_id").alias("oracle_id"), turn(2, "illustration_id").alias("illustration_id"), turn(3, "card_name").alias("name"), turn(4, "card_set_code").alias("set"), turn(4, "collector_number").alias("collector_number"))
    found, missing = collection(corpus(spark, d), asked)
    return found.select("position", "scryfall_id").unionByName(missing.select("position", F.lit(None).cast("string").alias("scryfall_id")))


SQL["jn_collection_kinds"] = printings_sql(
    "SELECT position, scryfall_id FROM (SELECT a.position, c.scryfall_id, row_number() OVER (PARTITION BY a.position ORDER BY c.is_canonical DESC NULLS LAST, CASE WHEN NOT isnan(c.prefer_score) THEN c.prefer_score END DESC NULLS LAST, c.scryfall_id) AS best FROM asked a LEFT JOIN named c ON a.key = c.key) WHERE best = 1",
    """asked AS (SELECT row_no AS position, CASE (row_no // 100) % 5 WHEN 0 THEN 'id ' || nullif(lower(trim(scryfall_id)), '') WHEN 1 THEN 'oracle ' || nullif(lower(trim(oracle_id)), '') WHEN 2 THEN 'art ' || nullif(lower(trim(illustration_id)), '')
         WHEN 3 THEN 'name ' || nullif(regexp_replace(lower(strip_accents(card_name)), '[^\\p{L}\\p{N}]+', '', 'g'), '') ELSE 'slot ' || lower(card_set_code) || ' ' || collector_number END AS key FROM printings WHERE row_no % 100 = 0),
       named AS (SELECT scryfall_id, is_canonical, prefer_score, unnest(['id ' || scryfall_id, 'oracle ' || oracle_id, 'art ' || illustration_id, 'name ' || nullif(name_key, ''), 'slot ' || lower(card_set_code) || ' ' || collector_number]) AS key FROM cur)""",
)


@_query
def cat_values(spark: SparkSession, d: str) -> DataFrame:
    """The catalogs that follow from the printings, a row a value."""
    c = corpus(spark, d)
    out = None
    for name in ("card-names", "supertypes", "card-types", "creature-types", "land-types", "spell-types", "keyword-abilities"):
        one = catalog(c, name).withColumn("catalog", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("catalog", "value")


_SUPER = "'Basic', 'Elite', 'Host', 'Legendary', 'Ongoing', 'Snow', 'World'"
SQL["cat_values"] = printings_sql(
    f"""SELECT DISTINCT * FROM (SELECT 'card-names' AS catalog, card_name AS value FROM cur UNION ALL SELECT CASE WHEN word IN ({_SUPER}) THEN 'supertypes' ELSE 'card-types' END, word FROM (SELECT unnest(types) AS word FROM half)
        UNION ALL SELECT 'creature-types', unnest(subtypes) FROM half WHERE list_has_any(types, ['Creature', 'Kindred', 'Tribal']) UNION ALL SELECT 'land-types', unnest(subtypes) FROM half WHERE list_contains(types, 'Land')
        UNION ALL SELECT 'spell-types', unnest(subtypes) FROM half WHERE list_has_any(types, ['Instant', 'Sorcery']) UNION ALL SELECT 'keyword-abilities', lower(unnest(card_keywords)) FROM cur) WHERE value <> ''""",
    """lines AS (SELECT unnest(string_split(type_line, ' // ')) AS t FROM cur), half AS (SELECT regexp_split_to_array(trim(split_part(t, '—', 1)), '\\s+') AS types, regexp_split_to_array(trim(split_part(t, '—', 2)), '\\s+') AS subtypes FROM lines)""",
)


@_query
def cat_names(spark: SparkSession, d: str) -> DataFrame:
    """How many values each of the named catalogs has over the raw records."""
    c = rules_corpus(spark, d)
    out = None
    for name in CATALOGS:
        one = catalog(c, name).agg(F.count("*").alias("n")).withColumn("catalog", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("catalog", "n")


@_query
def cat_symbols(spark: SparkSession, d: str) -> DataFrame:
    """The symbols of the raw records' costs and texts, with what they are worth and how many rows hold them."""
    return symbology(rules_corpus(spark, d)).select("symbol", "mana_value", F.array_join("colors", "").alias("colors"), "n_cards")


SQL["cat_symbols"] = _sql(
    """SELECT symbol, list_max(list_transform(parts, lambda p: CASE WHEN regexp_full_match(p, '[0-9]{1,9}') THEN CAST(p AS DOUBLE) WHEN regexp_full_match(p, '[WUBRGCSP]') THEN 1.0 ELSE 0.0 END)) AS mana_value,
       array_to_string(list_filter(['W', 'U', 'B', 'R', 'G'], lambda x: list_contains(parts, x)), '') AS colors, n_cards
       FROM (SELECT symbol, string_split(trim(symbol, '{}'), '/') AS parts, n_cards FROM (SELECT symbol, count(*) AS n_cards FROM
       (SELECT scryfall_id, unnest(list_distinct(regexp_extract_all(upper(concat_ws(' ', coalesce(face_costs[1], ''), array_to_string(list_transform(faces, lambda f: json_extract_string(f, '$.mana_cost')), ' '), rules)), '\\{[^{}\\s]+\\}'))) AS symbol FROM fin) GROUP BY 1))"""
)


@_query
def cat_set_list(spark: SparkSession, d: str) -> DataFrame:
    """The sets, each once, newest first."""
    return set_list(table(spark, d, "card_sets")).select(F.col("place").cast("bigint").alias("place"), "code", "id")


SQL["cat_set_list"] = "SELECT row_number() OVER (ORDER BY try_cast(released_at AS DATE) DESC NULLS LAST, code) - 1 AS place, code, id FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY id NULLS LAST, released_at NULLS LAST, set_name NULLS LAST, set_type NULLS LAST) AS n FROM (SELECT nullif(lower(trim(id)), '') AS id, lower(trim(code)) AS code, released_at, set_name, set_type FROM card_sets) WHERE code <> '') WHERE n = 1"


@_query
def jn_set_of(spark: SparkSession, d: str) -> DataFrame:
    """The sets that a code, an id and a number of another catalogue name."""
    sets = set_list(table(spark, d, "card_sets"))
    asked = ["WJZ", "1738", "5459b15f-bdac-4f11-8675-66f9a2f00d38", "none"]
    out = None
    for key in asked:
        one = set_of(sets, key).select(F.lit(key).alias("asked"), "code")
        out = one if out is None else out.unionByName(one)
    return out


SQL["jn_set_of"] = f"""WITH sets AS ({SQL["cat_set_list"].replace("place, code, id FROM", "place, code, id, tcgplayer_id FROM").replace("released_at, set_name, set_type FROM card_sets", "released_at, set_name, set_type, tcgplayer_id FROM card_sets")}),
    asked AS (SELECT unnest(['WJZ', '1738', '5459b15f-bdac-4f11-8675-66f9a2f00d38', 'none']) AS asked),
    hit AS (SELECT asked, code, row_number() OVER (PARTITION BY asked ORDER BY CASE WHEN code = lower(asked) THEN 0 WHEN id = lower(asked) THEN 1 ELSE 2 END, place) AS n FROM asked JOIN sets ON code = lower(asked) OR id = lower(asked) OR CAST(tcgplayer_id AS VARCHAR) = asked)
    SELECT asked, code FROM hit WHERE n = 1"""
