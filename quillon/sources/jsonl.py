"""Raw records: JSON lines, plain or compressed, parsed against one schema without a pass to infer it."""

from __future__ import annotations

import gzip
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FACE_FIELDS = (
    "name string, mana_cost string, type_line string, oracle_text string, power string, toughness string, loyalty string, defense string, colors array<string>, "
    "color_indicator array<string>, layout string, watermark string, flavor_text string, artist string, artist_id string, illustration_id string, printed_name string, printed_type_line string, "
    "printed_text string, flavor_name string, produced_mana array<string>, keywords array<string>"
)
#: The fields of a record that have columns of their own; all others stay in its ``residue``.
RECORD = (
    "id string, oracle_id string, name string, lang string, released_at string, layout string, type_line string, set string, set_id string, set_name string, set_type string, collector_number string, rarity string, "
    "artist string, border_color string, frame string, mana_cost string, oracle_text string, flavor_text string, cmc string, power string, toughness string, loyalty string, hand_modifier string, life_modifier string, watermark string, "
    "colors array<string>, color_identity array<string>, keywords array<string>, produced_mana array<string>, color_indicator array<string>, frame_effects array<string>, promo_types array<string>, finishes array<string>, games array<string>, "
    "artist_ids array<string>, multiverse_ids array<bigint>, illustration_id string, image_status string, edhrec_rank string, arena_id string, mtgo_id string, tcgplayer_id string, cardmarket_id string, "
    "booster boolean, digital boolean, foil boolean, nonfoil boolean, full_art boolean, game_changer boolean, highres_image boolean, oversized boolean, promo boolean, reprint boolean, reserved boolean, story_spotlight boolean, textless boolean, "
    "variation boolean, content_warning boolean, prices map<string,string>, legalities map<string,string>, printed_name string, printed_type_line string, printed_text string, flavor_name string, "
    f"card_faces array<struct<{FACE_FIELDS}>>"
)
#: A source of at least this size must parse to this share, or it is taken for broken.
MIN_BYTES, MIN_SHARE = 1_000_000, 0.8


def _ddl(fields: str) -> str:
    """``name type`` pairs as the members of a struct."""
    out, depth, word = [], 0, ""
    for c in fields + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, _, kind = word.strip().partition(" ")
            out.append(f"`{name}`:{kind}")
            word = ""
        else:
            word += c
    return ",".join(out)


def record_schema() -> str:
    """The DDL of a record as a struct."""
    head = RECORD.partition("card_faces ")[0]
    return f"struct<{_ddl(head.rstrip(', '))},card_faces:array<struct<{_ddl(FACE_FIELDS)}>>>"


def read_lines(spark: SparkSession, path: str, sniff: bool = False) -> DataFrame:
    """(line) of text files; compressed ones by their suffix.  Lines of large files are read in parallel splits.

    ``sniff`` also takes files for compressed that begin as such, whatever they are called; each such file, of one or
    more members, is then read by one task.
    """
    if not sniff:
        return spark.read.text(path).withColumnRenamed("value", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_buffer()
                whole = gzip.decompress(raw) if raw[:2].to_pybytes() == b"\x1f\x8b" else raw.to_pybytes()
                lines = whole.decode("utf-8", "replace").splitlines()
                for lo in range(0, len(lines), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(lines[lo : lo + 10_000], pa.string())], ["line"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "line string")


def local_dump(folder: str, kind: str) -> str:
    """The file of a kind of dump in a folder, under either of its spellings, plain or compressed."""
    for name in (kind, kind.replace("_", "-")):
        for suffix in (".jsonl", ".jsonl.gz", ".json", ".json.gz"):
            path = os.path.join(folder, name + suffix)
            if os.path.exists(path):
                return path
    raise FileNotFoundError(f"no dump of {kind} in {folder}")


def parse_records(lines: DataFrame, line: str = "line") -> DataFrame:
    """The table with ``record`` (null where the line is no JSON object), ``face_keys`` (the keys that each face has, those
    with a null value too) and ``residue``, the other keys as JSON texts.

    A field of another type than expected is null in its record; the record's other fields are kept.
    """
    text = F.btrim(F.col(line), F.lit(" \t\r\n,"))
    as_map = F.from_json(text, "map<string,string>")
    known = [f.split(":")[0].strip("`") for f in record_schema()[7:].split(",") if f.startswith("`")] + ["card_faces"]
    faces = F.from_json(F.try_element_at(as_map, F.lit("card_faces")), "array<map<string,string>>")
    return lines.withColumns({
        "record": F.when(F.startswith(text, F.lit("{")), F.from_json(text, record_schema(), {"mode": "PERMISSIVE"})),
        "face_keys": F.transform(faces, F.map_keys),
        "residue": F.map_filter(as_map, lambda k, _: ~k.isin(*set(known))),
    })


def checked(parsed: DataFrame, line: str = "line") -> DataFrame:
    """The parsed table without unreadable lines; raises if a source of some size is largely unreadable."""
    readable = F.col("record.id").isNotNull()
    size, all_, good = parsed.agg(F.coalesce(F.sum(F.octet_length(line)), F.lit(0)), F.count("*"), F.count_if(readable)).first()
    if size >= MIN_BYTES and good < MIN_SHARE * all_:
        raise ValueError(f"only {good} of {all_} lines are records")
    return parsed.where(readable)


def canonical_flag(rows: DataFrame, canonical_ids: DataFrame, key: str = "scryfall_id") -> Column | DataFrame:
    """Rows with ``is_canonical``: whether their id is among ``canonical_ids`` (id)."""
    ids = canonical_ids.select(F.lower("id").alias(key)).distinct().withColumn("_known", F.lit(True))
    return rows.join(ids, key, "left").withColumn("is_canonical", F.col("_known").isNotNull()).drop("_known")
