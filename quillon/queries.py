"""The core's queries over a folder of tables and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.columns import clean_id
from quillon.operators.flatten import flatten_lines, part_links
from quillon.operators.hierarchy import ancestors, roots, segments, summary
from quillon.operators.key_totals import distinct_ids, key_totals, large_keys
from quillon.operators.orphans import month_of, orphan_references
from quillon.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The cards that hold at least one percent of all printings."""
    return large_keys(table(spark, d, "printings"), "oracle_id", "scryfall_id", "imported_at", 1).select("oracle_id")


def p2_totals(spark: SparkSession, d: str) -> DataFrame:
    """Every card's printings, artworks, first and last delivery, and whether it is one of the large ones."""
    printings = table(spark, d, "printings")
    least = distinct_ids(printings, "scryfall_id")
    totals = key_totals(printings, "oracle_id", {"n_printings": "scryfall_id", "n_artworks": "illustration_id"}, "imported_at")
    return totals.withColumn("is_large", F.col("n_printings") * 100 >= F.lit(least))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Related parts with the record or part that holds them."""
    return part_links(table(spark, d, "bulk_lines"))


def _flat(kind: str, *columns: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        flat = flatten_lines(table(spark, d, "bulk_lines"), kinds=(kind,), fields=tuple(c for c in columns if c != "id"))
        return flat.select("line_no", "node_no", "parent_id", "parent_node", *columns)

    query.__doc__ = f"The flat table of {kind}s."
    return query


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    printings = table(spark, d, "printings")
    art = orphan_references(printings, "row_no", "illustration_id", "imported_at", table(spark, d, "artworks"), "illustration_id", "added_at", "withdrawn_at")
    cards = orphan_references(table(spark, d, "rulings"), "ruling_no", "oracle_id", "imported_at", printings, "oracle_id", "imported_at", "removed_at")
    named = lambda df, name, row: df.select(F.lit(name).alias("ref_table"), F.col(row).alias("row_no"), month_of(df).alias("import_month"))
    return named(art, "printings", "row_no").unionByName(named(cards, "rulings", "ruling_no"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows that refer to an artwork or card that was not present when they came in."""
    return _orphans(spark, d)


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references counted per table and month."""
    return _orphans(spark, d).groupBy("ref_table", "import_month").agg(F.count("*").alias("n_orphans"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every tag with every tag reached from it over its parents, and the fewest steps."""
    found = ancestors(table(spark, d, "tags"), "id", "parent_ids", ["updated_at", "row_no"])
    return found.select(F.col("id").alias("tag_id"), "ancestor_id", "steps")


def p5_tags(spark: SparkSession, d: str) -> DataFrame:
    """Every tag with a path to a root, depth, and numbers of roots, ancestors and descendants; whether it lies on a cycle."""
    return summary(table(spark, d, "tags"), "id", "parent_ids", ["updated_at", "row_no"]).withColumnRenamed("id", "tag_id")


def p5_roots(spark: SparkSession, d: str) -> DataFrame:
    """Every tag with every tag without parents that it reaches, and the fewest steps."""
    return roots(table(spark, d, "tags"), "id", "parent_ids", ["updated_at", "row_no"]).withColumnRenamed("id", "tag_id")


def p5_segments(spark: SparkSession, d: str) -> DataFrame:
    """The links above the first tags of tree paths, with the tree paths that go on there; they spell all paths."""
    return segments(table(spark, d, "tags"), "id", "parent_ids", ["updated_at", "row_no"]).withColumnRenamed("id", "tag_id")


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every tag's depth and numbers of ancestors, descendants and parents, and whether it lies on a cycle."""
    return p5_tags(spark, d).select("tag_id", "depth", "n_ancestors", "n_descendants", "n_parents", "in_cycle")


def p3_card_parts(spark: SparkSession, d: str) -> DataFrame:
    """How many related parts with an id there are of each component."""
    flat = flatten_lines(table(spark, d, "bulk_lines"), kinds=("part",), fields=("component",)).where("id is not null")
    return flat.groupBy(clean_id("component").alias("component")).agg(F.count("*").alias("n_parts"))


PROBLEMS = {
    "p2_found": p2_found,
    "p2_totals": p2_totals,
    "p3_found": p3_found,
    "p3_records": _flat("record", "id", "oracle_id", "name", "lang", "set", "released_at", "layout", "type_line"),
    "p3_faces": _flat("face", "name", "type_line", "mana_cost"),
    "p3_parts": _flat("part", "id", "component", "name", "type_line", "uri"),
    "p3_card_parts": p3_card_parts,
    "p4_found": p4_found,
    "p4_report": p4_report,
    "p5_found": p5_found,
    "p5_tags": p5_tags,
    "p5_roots": p5_roots,
    "p5_segments": p5_segments,
    "p5_counts": p5_counts,
}

_TEXT_OF = "CASE WHEN json_type(json_extract(v, '$.{0}')) IN ('VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE') THEN nullif(lower(trim(json_extract_string(v, '$.{0}'))), '') END"
_SEGMENT = "nullif(lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(json_extract_string(v, '$.uri'), '[?#].*$', ''), '^\\s*([a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/]*', ''), '[/\\s]+$', ''), '^.*/', ''))), '')"
_OWN_ID = f"CASE WHEN json_type(v) = 'OBJECT' THEN coalesce({_TEXT_OF.format('id')}, CASE WHEN json_type(json_extract(v, '$.uri')) = 'VARCHAR' THEN {_SEGMENT} END) END"
#: Every value of the lines with what it stands in; a text inside related parts that is JSON is walked as a list of that one value.
_NODES = f"""
    node AS (
        SELECT line_no, CAST(line AS VARCHAR) AS v, false AS parts, false AS faces, CAST(NULL AS VARCHAR) AS near FROM bulk_lines WHERE json_valid(line)
        UNION ALL
        SELECT c.line_no, j.value, c.parts OR j.key = 'all_parts', c.faces OR j.key = 'card_faces', CASE WHEN c.own IS NOT NULL AND (c.parts OR NOT c.faces) THEN c.own ELSE c.near END
        FROM (SELECT *, {_OWN_ID} AS own, CASE WHEN json_type(v) IN ('OBJECT', 'ARRAY') THEN v WHEN json_type(v) = 'VARCHAR' AND parts AND json_valid(json_extract_string(v, '$')) THEN '[' || json_extract_string(v, '$') || ']' END AS box FROM node) c,
             json_each(c.box) j
        WHERE c.box IS NOT NULL)"""
_ABSENT = """
    SELECT 'printings' AS ref_table, p.row_no, strftime(p.imported_at, '%Y-%m') AS import_month FROM printings p
    WHERE trim(p.illustration_id) <> '' AND p.imported_at IS NOT NULL AND NOT EXISTS (
        SELECT 1 FROM artworks a WHERE lower(trim(a.illustration_id)) = lower(trim(p.illustration_id))
        AND a.added_at <= p.imported_at AND (a.withdrawn_at IS NULL OR a.withdrawn_at > p.imported_at))
    UNION ALL
    SELECT 'rulings', r.ruling_no, strftime(r.imported_at, '%Y-%m') FROM rulings r
    WHERE trim(r.oracle_id) <> '' AND r.imported_at IS NOT NULL AND NOT EXISTS (
        SELECT 1 FROM printings p WHERE lower(trim(p.oracle_id)) = lower(trim(r.oracle_id))
        AND p.imported_at <= r.imported_at AND (p.removed_at IS NULL OR p.removed_at > r.imported_at))"""
_TOTALS = """
    SELECT lower(trim(oracle_id)) AS oracle_id, count(DISTINCT nullif(lower(trim(scryfall_id)), '')) AS n_printings,
           count(DISTINCT nullif(lower(trim(illustration_id)), '')) AS n_artworks,
           min(imported_at) AS first_imported_at, max(imported_at) AS last_imported_at,
           count(DISTINCT nullif(lower(trim(scryfall_id)), '')) * 100
             >= (SELECT count(DISTINCT nullif(lower(trim(scryfall_id)), '')) FROM printings) AS is_large
    FROM printings WHERE trim(oracle_id) <> '' GROUP BY 1"""
_LINKS = """
        latest AS (
            SELECT lower(trim(id)) AS id, parent_ids,
                   row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY updated_at DESC NULLS LAST, row_no DESC) AS newest
            FROM tags WHERE trim(id) <> ''),
        tag AS (SELECT id, parent_ids FROM latest WHERE newest = 1),
        link AS (
            SELECT DISTINCT u.id AS child, lower(trim(u.p)) AS parent FROM (SELECT id, unnest(parent_ids) AS p FROM tag) u
            WHERE lower(trim(u.p)) IN (SELECT id FROM tag)),
        walk AS (
            SELECT child AS tag_id, parent AS ancestor_id, 1 AS steps, [parent] AS seen FROM link
            UNION ALL
            SELECT w.tag_id, l.parent, w.steps + 1, list_append(w.seen, l.parent) FROM walk w JOIN link l ON l.child = w.ancestor_id
            WHERE NOT list_contains(w.seen, l.parent))"""
PROBLEM_SQL = {
    "p2_found": f"SELECT oracle_id FROM ({_TOTALS}) WHERE is_large",
    "p2_totals": _TOTALS,
    "p4_found": _ABSENT,
    "p4_report": f"SELECT ref_table, import_month, count(*) AS n_orphans FROM ({_ABSENT}) GROUP BY 1, 2",
    "p3_found": f"WITH RECURSIVE {_NODES} SELECT DISTINCT line_no, near AS parent_id, part_id FROM (SELECT line_no, near, {_OWN_ID} AS part_id FROM node WHERE parts) WHERE part_id IS NOT NULL",
    "p3_card_parts": f"WITH RECURSIVE {_NODES} SELECT component, count(*) AS n_parts FROM (SELECT {_TEXT_OF.format('component')} AS component, {_OWN_ID} AS own FROM node WHERE parts) WHERE own IS NOT NULL GROUP BY 1",
    "p5_found": f"WITH RECURSIVE {_LINKS} SELECT tag_id, ancestor_id, CAST(min(steps) AS INTEGER) AS steps FROM walk GROUP BY 1, 2",
    "p5_roots": f"""WITH RECURSIVE {_LINKS}, top AS (SELECT id FROM tag WHERE id NOT IN (SELECT child FROM link))
        SELECT tag_id, ancestor_id AS root_id, CAST(min(steps) AS INTEGER) AS steps FROM walk WHERE ancestor_id IN (SELECT id FROM top) GROUP BY 1, 2 UNION ALL SELECT id, id, 0 FROM top""",
    "p5_counts": f"""WITH RECURSIVE {_LINKS}, top AS (SELECT id FROM tag WHERE id NOT IN (SELECT child FROM link)), pair AS (SELECT tag_id, ancestor_id, min(steps) AS steps FROM walk GROUP BY 1, 2)
        SELECT id AS tag_id, CASE WHEN id IN (SELECT id FROM top) THEN 0 ELSE (SELECT CAST(min(steps) AS INTEGER) FROM pair WHERE tag_id = t.id AND ancestor_id IN (SELECT id FROM top)) END AS depth,
               (SELECT count(*) FROM pair WHERE tag_id = t.id) AS n_ancestors, (SELECT count(*) FROM pair WHERE ancestor_id = t.id) AS n_descendants, (SELECT count(*) FROM link WHERE child = t.id) AS n_parents,
               EXISTS (SELECT 1 FROM pair WHERE tag_id = t.id AND ancestor_id = t.id) AS in_cycle FROM tag t""",
}
