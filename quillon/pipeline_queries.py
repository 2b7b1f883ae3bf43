"""Queries of the row pipeline: records to rows, tags, sinks; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.transform import tag_aliases, tag_lists, tag_reach, transform
from quillon.search_queries import _sql, corpus
from quillon.sinks.render import card_text, csv_columns
from quillon.sources.jsonl import checked, parse_records
from quillon.sources.tables import table


def rows(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue rows of the raw lines."""
    return transform(checked(parse_records(table(spark, d, "bulk_lines"))))


QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def src_records(spark: SparkSession, d: str) -> DataFrame:
    """The lines that hold one record, with its id."""
    return checked(parse_records(table(spark, d, "bulk_lines"))).select("line_no", F.col("record.id").alias("id"))


SQL["src_records"] = "SELECT line_no, json_extract_string(line, '$.id') AS id FROM bulk_lines WHERE json_valid(line) AND json_type(line) = 'OBJECT' AND json_extract_string(line, '$.id') IS NOT NULL"

_J = lambda k: f"json_extract_string(line, '$.{k}')"
_TYPED = lambda k, t: f"json_type(json_extract(line, '$.{k}')) = '{t}'"
_WHOLE = f"""json_valid(line) AND json_type(line) = 'OBJECT' AND {" AND ".join(f"{_J(k)} IS NOT NULL" for k in ("id", "oracle_id", "name", "released_at", "type_line"))}
    AND {_TYPED("colors", "ARRAY")} AND {_TYPED("color_identity", "ARRAY")} AND {_TYPED("legalities", "OBJECT")}
    AND (NOT coalesce({_TYPED("card_faces", "ARRAY")}, false) OR json_array_length(json_extract(line, '$.card_faces')) > 0)"""
_RARITY = f"CASE lower({_J('rarity')}) WHEN 'common' THEN 0 WHEN 'uncommon' THEN 1 WHEN 'rare' THEN 2 WHEN 'special' THEN 3 WHEN 'mythic' THEN 4 WHEN 'bonus' THEN 5 ELSE CASE WHEN length({_J('rarity')}) > 0 THEN -1 END END"


@_query
def prj_rows(spark: SparkSession, d: str) -> DataFrame:
    """The plain columns of the rows."""
    return rows(spark, d).select("line_no", "scryfall_id", "oracle_id", "card_name", "card_lang", "card_set_code", "card_rarity_int", F.col("collector_number_int"), "cmc", "edhrec_rank", "price_usd", "price_eur")


SQL["prj_rows"] = f"""
    SELECT line_no, nullif(lower(trim({_J('id')})), '') AS scryfall_id, nullif(lower(trim({_J('oracle_id')})), '') AS oracle_id, {_J('name')} AS card_name, lower({_J('lang')}) AS card_lang, lower({_J('set')}) AS card_set_code,
           CAST({_RARITY} AS BIGINT) AS card_rarity_int, CAST(try_cast(regexp_replace({_J('collector_number')}, '[^0-9]', '', 'g') AS INTEGER) AS BIGINT) AS collector_number_int, try_cast({_J('cmc')} AS DOUBLE) AS cmc,
           try_cast({_J('edhrec_rank')} AS BIGINT) AS edhrec_rank, coalesce(try_cast({_J('prices.usd')} AS DOUBLE), try_cast({_J('prices.usd_foil')} AS DOUBLE), try_cast({_J('prices.usd_etched')} AS DOUBLE)) AS price_usd,
           coalesce(try_cast({_J('prices.eur')} AS DOUBLE), try_cast({_J('prices.eur_foil')} AS DOUBLE)) AS price_eur
    FROM bulk_lines WHERE {_WHOLE}"""


@_query
def prj_type_words(spark: SparkSession, d: str) -> DataFrame:
    """Types and subtypes of rows without faces, one word a row; ``prj_type_words_all`` has those of all rows."""
    return _type_words(rows(spark, d).where("size(card_faces) = 0"))


def _type_words(r: DataFrame) -> DataFrame:
    return r.select("line_no", F.lit("type").alias("kind"), F.explode("card_types").alias("word")).unionByName(r.select("line_no", F.lit("subtype").alias("kind"), F.explode("card_subtypes").alias("word")))


SQL["prj_type_words"] = f"""
    WITH r AS (SELECT line_no, {_J('type_line')} AS t FROM bulk_lines WHERE {_WHOLE} AND NOT coalesce({_TYPED('card_faces', 'ARRAY')}, false)),
    w AS (SELECT line_no, 'type' AS kind, unnest(regexp_split_to_array(split_part(t, '—', 1), '\\s+')) AS word FROM r
          UNION ALL SELECT line_no, 'subtype', unnest(regexp_split_to_array(split_part(t, '—', 2), '\\s+')) FROM r)
    SELECT DISTINCT line_no, kind, word FROM w WHERE word <> ''"""


@_query
def prj_type_words_all(spark: SparkSession, d: str) -> DataFrame:
    """Types and subtypes of all rows, those of a row's faces merged, one word a row."""
    return _type_words(rows(spark, d))


SQL["prj_type_words_all"] = f"""
    WITH r AS (SELECT line_no, unnest(CASE WHEN {_TYPED('card_faces', 'ARRAY')} THEN list_transform(json_extract(line, '$.card_faces[*]'), lambda f: CASE WHEN json_exists(f, '$.type_line') THEN json_extract_string(f, '$.type_line') ELSE {_J('type_line')} END) ELSE [{_J('type_line')}] END) AS t FROM bulk_lines WHERE {_WHOLE}),
    w AS (SELECT line_no, 'type' AS kind, unnest(regexp_split_to_array(split_part(t, '—', 1), '\\s+')) AS word FROM r
          UNION ALL SELECT line_no, 'subtype', unnest(regexp_split_to_array(split_part(t, '—', 2), '\\s+')) FROM r)
    SELECT DISTINCT line_no, kind, word FROM w WHERE word <> ''"""


_TAG_CTE = """
    latest AS (SELECT lower(trim(id)) AS id, trim(regexp_replace(lower(slug), '[^a-z0-9]+', '-', 'g'), '-') AS slug, parent_ids, aliases, taggings,
                      row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY updated_at DESC NULLS LAST, row_no DESC) AS newest FROM tags WHERE trim(id) <> ''),
    tag AS (SELECT * FROM latest WHERE newest = 1),
    link AS (SELECT DISTINCT id AS child, lower(trim(p)) AS parent FROM (SELECT id, unnest(parent_ids) AS p FROM tag) WHERE lower(trim(p)) IN (SELECT id FROM tag)),
    walk AS (SELECT id, id AS up FROM tag UNION SELECT w.id, l.parent FROM walk w JOIN link l ON l.child = w.up)"""


def _tags_sql(of: str) -> str:
    return f"""WITH RECURSIVE {_TAG_CTE},
        tagged AS (SELECT DISTINCT id, nullif(lower(trim(t.{of})), '') AS {of} FROM (SELECT id, unnest(taggings) AS t FROM tag WHERE slug <> ''))
        SELECT {of}, list_sort(list(DISTINCT u.slug)) AS tags FROM tagged JOIN walk w USING (id) JOIN tag u ON u.id = w.up WHERE {of} IS NOT NULL AND u.slug <> '' GROUP BY 1"""


@_query
def jn_oracle_tags(spark: SparkSession, d: str) -> DataFrame:
    """Every card's tags, broader ones included."""
    return tag_lists(*tag_reach(table(spark, d, "tags")), "oracle_id")


@_query
def jn_art_tags(spark: SparkSession, d: str) -> DataFrame:
    """Every artwork's tags, broader ones included."""
    return tag_lists(*tag_reach(table(spark, d, "tags")), "illustration_id")


SQL["jn_oracle_tags"], SQL["jn_art_tags"] = _tags_sql("oracle_id"), _tags_sql("illustration_id")


@_query
def jn_tag_aliases(spark: SparkSession, d: str) -> DataFrame:
    """What other names of tags stand for."""
    return tag_aliases(table(spark, d, "tags"))


SQL["jn_tag_aliases"] = f"""WITH RECURSIVE {_TAG_CTE},
    claim AS (SELECT slug, trim(regexp_replace(lower(a), '[^a-z0-9]+', '-', 'g'), '-') AS alias FROM (SELECT slug, unnest(aliases) AS a FROM tag WHERE slug <> ''))
    SELECT alias, min(slug) AS slug FROM claim WHERE alias <> '' AND alias NOT IN (SELECT slug FROM tag WHERE slug <> '') GROUP BY 1 HAVING count(DISTINCT slug) = 1"""


@_query
def jn_set_of_printing(spark: SparkSession, d: str) -> DataFrame:
    """Every printing's set row, of repeated set rows the least by id."""
    sets = table(spark, d, "card_sets").withColumn("code", F.lower("code")).groupBy("code").agg(F.min_by(F.struct("id", "set_type"), F.col("id")).alias("s"))
    return corpus(spark, d).select("scryfall_id", "set_code").join(sets, F.col("set_code") == F.col("code")).select("scryfall_id", F.col("s.id").alias("set_id"))


SQL["jn_set_of_printing"] = _sql("SELECT c.scryfall_id, s.id AS set_id FROM cur c JOIN (SELECT lower(code) AS code, min(id) AS id FROM card_sets GROUP BY 1) s ON lower(c.card_set_code) = s.code")


@_query
def snk_csv(spark: SparkSession, d: str) -> DataFrame:
    """The CSV columns of all printings."""
    return csv_columns(corpus(spark, d))


_DECIMAL = lambda c: f"CASE WHEN {c} = trunc({c}) AND abs({c}) < 1e7 THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) || '.0' ELSE CAST({c} AS VARCHAR) END"
_SLUG = "replace(replace(replace(replace(replace(replace(replace(url_encode(regexp_replace(regexp_replace(lower(card_name), '[''\",./“”]', '', 'g'), ' +', '-', 'g')), '%21', '!'), '%26', '&'), '%28', '('), '%29', ')'), '%2B', '+'), '%3A', ':'), '%3D', '=')"
SQL["snk_csv"] = _sql(f"""
    SELECT CAST(NULL AS VARCHAR) AS multiverse_id, CAST(NULL AS VARCHAR) AS mtgo_id, upper(card_set_code) AS set, collector_number, card_lang AS lang, CASE card_rarity_int WHEN 0 THEN 'C' WHEN 1 THEN 'U' WHEN 2 THEN 'R' WHEN 3 THEN 'S' WHEN 4 THEN 'M' WHEN 5 THEN 'B' END AS rarity, card_name AS name,
           CASE WHEN len(card_faces) > 0 THEN array_to_string(list_filter(list_transform(card_faces, lambda f: f.mana_cost), lambda c: length(c) > 0), ' // ') END AS mana_cost, {_DECIMAL("cmc")} AS cmc, type_line, card_artist AS artist,
           {_DECIMAL("price_usd")} AS usd_price, CAST(NULL AS VARCHAR) AS usd_foil_price, {_DECIMAL("price_eur")} AS eur_price, CAST(NULL AS VARCHAR) AS tix_price, '/images/large/front/' || scryfall_id[1] || '/' || scryfall_id[2] || '/' || scryfall_id || '.jpg' AS image_uri,
           '/card/' || lower(card_set_code) || '/' || url_encode(collector_number) || CASE WHEN lower(card_lang) <> 'en' THEN '/' || lower(card_lang) ELSE '' END || '/' || {_SLUG} AS scryfall_uri, scryfall_id FROM cur""")


@_query
def snk_text(spark: SparkSession, d: str) -> DataFrame:
    """Every printing as plain lines."""
    return corpus(spark, d).select("scryfall_id", card_text().alias("text"))


SQL["snk_text"] = _sql("""SELECT scryfall_id, CASE WHEN len(card_faces) > 0 THEN array_to_string(list_transform(card_faces, lambda f: concat_ws(chr(10), concat_ws(' ', coalesce(f.name, ''), nullif(f.mana_cost, '')), nullif(f.type_line, ''))), chr(10) || chr(10))
    ELSE concat_ws(chr(10), card_name, nullif(type_line, '')) END AS text FROM cur""")


@_query
def cat_sets(spark: SparkSession, d: str) -> DataFrame:
    """The sets, by code, with how many printings they hold."""
    return corpus(spark, d).groupBy("set_code").agg(F.count("*").alias("n_printings"), F.count_distinct("oracle_id").alias("n_cards"))


SQL["cat_sets"] = _sql("SELECT lower(card_set_code) AS set_code, count(*) AS n_printings, count(DISTINCT oracle_id) AS n_cards FROM cur GROUP BY 1")
