"""Nested JSON records as flat tables of records, faces and related parts, each row naming its parent.

A column of raw lines is flattened batch by batch over its Arrow buffers (see ``functions.json_tape``): list and
object members become child rows through parent indices, ids and parents' ids travel down by vectorised take.  Text
that itself holds JSON is flattened in a further pass whose rows start below the node that held the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import json_tape
from quillon.functions.columns import BLANKS
from quillon.runtime import materialise, ship_code

#: Bytes of text flattened at a time; bounds a task's memory.
CHUNK_BYTES = 4 << 20
_FIELDS = ("oracle_id", "name", "lang", "set", "released_at", "layout", "type_line", "mana_cost", "component", "uri")
#: Members by which an object without an id is known as a part or a record.
_OF_PARTS, _OF_RECORDS = ("id", "uri", "object", "component", "name", "type_line"), ("oracle_id", "type_line", "all_parts", "card_faces")
KINDS = ("record", "face", "part")
#: The bytes with which such a text can begin: brackets, blanks, and the backslash of an escape.
_FIRST = np.frombuffer(b'[{ \t\n\r\\', np.uint8)
#: How a text begins that may hold an object or a list of objects, or a text that does.
_HOLDS_JSON, _HOLDS_OBJECT = r'^\s*[\[{"]', r'^\s*(?:\{\s*"|\[\s*[\[{"]|"[\s\\]*[\[{])'
_BASE = {"kind": pa.string(), "line_no": pa.int64(), "node_no": pa.int64(), "id": pa.string(), "parent_id": pa.string(), "parent_node": pa.int64()}


def _clean(ids: pa.Array) -> pa.Array:
    ids = pc.utf8_lower(pc.utf8_trim(ids, BLANKS))
    return pc.if_else(pc.equal(ids, ""), pa.scalar(None, pa.string()), ids)


def _last_segment(uris: pa.Array) -> pa.Array:
    """The last non-empty segment of each uri's path."""
    path = pc.replace_substring_regex(uris, r"[?#][\s\S]*$", "")
    path = pc.replace_substring_regex(path, r"^\s*([a-zA-Z][a-zA-Z0-9+.\-]*:)?//[^/]*", "")
    path = pc.replace_substring_regex(path, r"[/\s]+$", "")
    return pc.replace_substring_regex(path, r"^[\s\S]*/", "")


def _flatten(lines: pa.Array, line_no: pa.Array, kinds: tuple[str, ...], fields: tuple[str, ...]) -> list[pa.Table]:
    """The rows of one chunk; ``above`` and ``above_node`` hold, in later layers, the parent's id and number, and what
    the text stood in.  A text is shorter than the one that held it, so the layers come to an end."""
    out: list[pa.Table] = []
    schema = pa.schema([*_BASE.items(), *((f, pa.string()) for f in fields)])
    above, above_node = pa.nulls(len(lines), pa.string()), np.full(len(lines), -1)
    in_parts, in_faces, order = np.zeros(len(lines), bool), np.zeros(len(lines), bool), np.zeros(len(lines), np.int64)
    while len(lines):
        tape = json_tape.read(lines)
        n = len(tape.kind)
        if not n:
            break
        ids = _clean(tape.text(tape.child("id")))
        ids = pc.coalesce(ids, _clean(_last_segment(tape.text(tape.child("uri")))))
        object_ = tape.kind == json_tape.OBJECT
        has_id = object_ & ~ids.is_null().to_numpy(zero_copy_only=False)
        own_faces = tape.key == tape.key_code("card_faces")
        parts = tape.inherit((tape.key == tape.key_code("all_parts")) | ((tape.parent < 0) & in_parts[tape.row]))
        faces = tape.inherit(own_faces | ((tape.parent < 0) & in_faces[tape.row])) & ~parts
        linked = has_id & (parts | ~faces)
        near = tape.nearest(linked)
        members = lambda names: np.any([tape.child(k) >= 0 for k in names], axis=0)
        # an object whose members are all objects or lists is a map of parts, an empty one a part only in a list
        flat = np.zeros(n, bool)
        flat[tape.parent[(tape.parent >= 0) & (tape.kind != json_tape.OBJECT) & (tape.kind != json_tape.ARRAY)]] = True
        nested = np.zeros(n, bool)
        nested[tape.parent[tape.parent >= 0]] = True
        listed = (tape.parent >= 0) & (tape.kind[np.maximum(tape.parent, 0)] == json_tape.ARRAY)
        part = object_ & parts & (has_id | (flat & (listed | members(_OF_PARTS))) | (listed & ~nested))
        record = object_ & ~parts & ~faces & (has_id | members(_OF_RECORDS))
        holder = tape.nearest(part | record)
        outer = above.take(pa.array(tape.row))
        parent_id = pc.if_else(pa.array(near >= 0), ids.take(pa.array(near, mask=near < 0)), outer)
        up = np.maximum(tape.parent, 0)
        face = object_ & faces & (own_faces | (own_faces[up] & (tape.parent >= 0) & (tape.kind[up] == json_tape.ARRAY)) | ((tape.parent < 0) & in_faces[tape.row]))
        # counted from the text's own value, so that numbers are within those of the string that held the text
        own = np.zeros(len(lines), np.int64)
        own[tape.row[tape.parent < 0]] = tape.start[tape.parent < 0]
        number = order[tape.row] + tape.start - own[tape.row]
        parent_node = np.where(holder >= 0, number[np.maximum(holder, 0)], above_node[tape.row])
        for kind, chosen in (("record", record), ("face", face), ("part", part)):
            at = np.flatnonzero(chosen)
            if kind in kinds and len(at):
                pick = pa.array(at)
                own_fields = [tape.text(tape.child(f)[at]) for f in fields]
                out.append(pa.Table.from_arrays([pa.array([kind] * len(at)), line_no.take(pa.array(tape.row[at])), pa.array(number[at]), ids.take(pick), parent_id.take(pick), pa.array(parent_node[at], mask=parent_node[at] < 0), *own_fields], schema=schema))
        # texts that hold JSON: inside related parts any, elsewhere those that can hold objects
        text = np.flatnonzero((tape.kind == json_tape.STRING) & (tape.end - tape.start > 3))
        second = tape.data[tape.start[text] + 1]
        text = text[np.isin(second, _FIRST)]
        body = tape.text(text)
        held = pc.match_substring_regex(body, _HOLDS_JSON).to_numpy(zero_copy_only=False)
        held &= parts[text] | pc.match_substring_regex(body, _HOLDS_OBJECT).to_numpy(zero_copy_only=False)
        text = text[held]
        if not len(text):
            break
        lines, line_no, above = body.filter(pa.array(held)), line_no.take(pa.array(tape.row[text])), parent_id.take(pa.array(text))
        in_parts, in_faces, order, above_node = parts[text], faces[text], number[text], parent_node[text]
    return out


def _run(kinds: tuple[str, ...], fields: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            line_no, lines = batch.column(0), batch.column(1)
            ends = np.cumsum(pc.fill_null(pc.binary_length(lines), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = np.flatnonzero(np.diff(ends // CHUNK_BYTES)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if hi > lo:
                    for table in _flatten(lines.slice(lo, hi - lo), line_no.slice(lo, hi - lo), kinds, fields):
                        yield from table.combine_chunks().to_batches()

    return run


def flatten_lines(df: DataFrame, line_no: str = "line_no", line: str = "line", kinds: tuple[str, ...] = KINDS, fields: tuple[str, ...] = _FIELDS) -> DataFrame:
    """All records, faces and related parts of a table of JSON lines, one row each; only these ``kinds`` and ``fields``.

    ``kind`` is record, face or part; ``id`` the object's own id (its ``id``, else the last non-empty segment of its
    ``uri``'s path), ``parent_id`` that of the closest record or part around it that has one (null: none has).
    ``node_no`` orders the rows of a line and ``parent_node`` is that of the closest record or part around the object,
    with or without an id (null: there is none); the other columns are the object's own fields of these names, null where
    missing or of another type (numbers come as their text).

    Text that holds JSON is flattened like the rest, however deep such texts lie within each other: any text inside related
    parts, elsewhere text that begins as an object or as a list of objects, lists or texts does.

    A part is an object anywhere inside a value of the key ``all_parts``: list, list of lists, object, map of objects, or
    text that holds such JSON, at any depth.  Without an id, which leaves ``id`` null, it is a part if it stands in a
    list and holds nothing or any plain value, or elsewhere if it holds a plain value and a member that parts have, so
    that maps are no parts.  A face is an element of ``card_faces``.  A record is any other object with an id, or without
    one if it has an ``oracle_id``, ``type_line``, ``all_parts`` or ``card_faces``.  A line that is not one complete JSON value gives no rows; nor do null and empty lines.  Of
    repeated keys in an object the last one counts.  Repeated lines give their rows again.  Further columns of the
    table are never read.
    """
    ship_code(df.sparkSession)
    schema = ", ".join(f"{c} {'bigint' if t == pa.int64() else 'string'}" for c, t in [*_BASE.items(), *((f, pa.string()) for f in fields)])
    return df.select(F.col(line_no).cast("bigint"), F.col(line).cast("string")).mapInArrow(_run(kinds, fields), schema)


def flat_tables(df: DataFrame, line_no: str = "line_no", line: str = "line") -> dict[str, DataFrame]:
    """The tables ``record``, ``face`` and ``part`` of ``flatten_lines``, flattened once and kept by kind."""
    kept, _ = materialise(flatten_lines(df, line_no, line), "flat", partition_by="kind")
    return {k: kept.where(F.col("kind") == k).drop("kind") for k in KINDS}


def part_links(df: DataFrame, line_no: str = "line_no", line: str = "line") -> DataFrame:
    """The distinct (line, parent id, part id) of all related parts that have an id."""
    return flatten_lines(df, line_no, line, ("part",), ()).where("id is not null").select("line_no", "parent_id", F.col("id").alias("part_id")).distinct()
