"""The package's queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.columns import clean_id
from quillon.llm.leaks import find_leaks
from quillon.llm.mixture import TARGETED, mix
from quillon.llm.pages import list_pages, page_kinds
from quillon.llm.top_groups import latest_delivery, top_n
from quillon.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The three printings of greatest score of every card."""
    printings = table(spark, d, "printings")
    one = latest_delivery(printings, "scryfall_id", ["imported_at", "row_no"], ["oracle_id", "prefer_score"])
    best = top_n(one.withColumn("oracle_id", clean_id("oracle_id")), "oracle_id", "prefer_score", ["scryfall_id"], 3, scores=printings)
    return best.select("oracle_id", F.col("rank_no").cast("int").alias("rank_no"), "scryfall_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that hold twelve words in a row of a test item, or all of a shorter one."""
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), errors=1).where("edits = 0").select("doc_id", "item_id")


def p6_edited(spark: SparkSession, d: str) -> DataFrame:
    """As p6_found, but up to two characters of a passage may differ; with the passages held and the fewest edits."""
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), errors=2)


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Every test item with the number of documents that hold it, and of those that hold all its passages."""
    leaks = find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), errors=1).where("edits = 0")
    per_item = leaks.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.count_if(F.col("exact_passages") == F.col("of_passages")).alias("n_whole"))
    items = table(spark, d, "eval_items").select("item_id", "suite")
    return items.join(per_item, "item_id", "left").na.fill(0, ["n_documents", "n_whole"])


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mix, a row a copy."""
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share and copies of every source of the mix."""
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p7_whole(spark: SparkSession, d: str) -> DataFrame:
    """The documents of a mix as large as all documents of its sources, a row a copy; sources that fall short are used as
    often as they may, and the others make up for them."""
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), TARGETED)[0]


def p7_whole_report(spark: SparkSession, d: str) -> DataFrame:
    """The report of p7_whole, with the tokens that each source falls short of."""
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), TARGETED)[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The pages more than half of whose words are keywords, links, or product and tag lists."""
    return list_pages(table(spark, d, "documents")).select("doc_id")


def p8_kinds(spark: SparkSession, d: str) -> DataFrame:
    """How many words of every page lie in prose, link lists, tag lists and menus."""
    return page_kinds(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p6_found, p6_edited, p6_items, p7_mix, p7_report, p7_whole, p7_whole_report, p8_found, p8_kinds)}

_WORDS = "list_filter(string_split_regex(lower(regexp_replace(strip_accents({0}), '[\\p{{Cf}}]', '', 'g')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
_HELD = f"""
    item AS (SELECT item_id, w, len(w) AS n FROM (SELECT item_id, {_WORDS.format('text')} AS w FROM eval_items WHERE text IS NOT NULL) WHERE len(w) > 0),
    doc AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
    passage AS (SELECT DISTINCT item_id, least(n, 12) AS size, array_to_string(w[i:i + least(n, 12) - 1], ' ') AS p FROM (SELECT *, unnest(range(1, greatest(n - 12, 0) + 2)) AS i FROM item)),
    sizes AS (SELECT DISTINCT size FROM passage),
    run AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + size - 1], ' ') AS p FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, sizes WHERE len(w) >= size)),
    held AS (SELECT r.doc_id, q.item_id, count(*) AS passages, (SELECT count(*) FROM passage o WHERE o.item_id = q.item_id) AS of_passages FROM run r JOIN passage q ON r.p = q.p GROUP BY 1, 2)"""
ORACLE = {
    "p6_found": f"WITH {_HELD} SELECT doc_id, item_id FROM held",
    "p6_items": f"""WITH {_HELD} SELECT e.item_id, e.suite, coalesce(h.n_documents, 0) AS n_documents, coalesce(h.n_whole, 0) AS n_whole FROM eval_items e
        LEFT JOIN (SELECT item_id, count(DISTINCT doc_id) AS n_documents, count(*) FILTER (passages = of_passages) AS n_whole FROM held GROUP BY 1) h USING (item_id)""",
    "p1_found": """
        WITH deliveries AS (
            SELECT lower(trim(scryfall_id)) AS scryfall_id, nullif(lower(trim(oracle_id)), '') AS oracle_id, prefer_score,
                   row_number() OVER (PARTITION BY lower(trim(scryfall_id)) ORDER BY imported_at DESC NULLS LAST, row_no DESC) AS newest
            FROM printings WHERE trim(scryfall_id) <> ''),
        ranked AS (
            SELECT oracle_id, scryfall_id,
                   CAST(row_number() OVER (PARTITION BY oracle_id ORDER BY prefer_score DESC, scryfall_id) AS INTEGER) AS rank_no
            FROM deliveries
            WHERE newest = 1 AND oracle_id IS NOT NULL AND prefer_score IS NOT NULL AND NOT isnan(prefer_score))
        SELECT oracle_id, rank_no, scryfall_id FROM ranked WHERE rank_no <= 3""",
}
