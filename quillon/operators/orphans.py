"""References to records that are missing, gone or not there yet, with the time of each reference.

Both sides are brought to (key, month) facts before any shuffle by key, so a key that holds a third of all rows moves
as a few facts: a reference fact says that a key was referred to in a month; a parent fact says that a key was present
in all of the months a..b, from a moment in month a to its end, from the start of month a until a moment, or only
within month a.  Per range of keys the keys become integers, the facts compressed bitmaps per month, and

    orphans = referred AND NOT (present all month OR present for part of it)

Keys present for part of a month are then compared row by row with the moments kept for that month.

A (key, month) with very many rows gets its verdict by broadcast, of at most 1 / SHARE such; the others are joined by a
shuffle, in which none is large against a task, and adaptive execution splits a partition that still is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.bitmap import Bitmap
from quillon.functions.columns import clean_id, month_number, month_text
from quillon.operators.key_totals import _encode
from quillon.plans.skew import HEAVY_ROWS, SHARE
from quillon.runtime import blocks_for, materialise

_REF, _ALL, _FROM, _UNTIL, _WITHIN = range(5)
_OK, _ORPHAN, _CHECK = range(3)
_FOREVER = 12 * 10_000
_FACTS = "key string, kind int, a int, b int, moment_from timestamp_ntz, moment_until timestamp_ntz, n bigint"
_VERDICTS = T.StructType([T.StructField("key", T.StringType()), T.StructField("month", T.IntegerType()), T.StructField("verdict", T.IntegerType()), T.StructField("from", T.TimestampNTZType()), T.StructField("until", T.TimestampNTZType()), T.StructField("within", T.BooleanType()), T.StructField("n", T.LongType())])


def _month_start(number: Column) -> Column:
    return F.make_date(F.floor(number / 12).cast("int"), (number % 12 + 1).cast("int"), F.lit(1)).cast("timestamp_ntz")


def _spans(parents: DataFrame, key: str, since: str, until: str) -> DataFrame:
    """The spans in which a key is present; those that end before they begin are none."""
    s = parents.select(clean_id(key).alias("key"), F.col(since).alias("since"), F.col(until).alias("until"))
    s = s.where(F.col("key").isNotNull() & F.col("since").isNotNull() & (F.col("until").isNull() | (F.col("until") > F.col("since"))))
    return s.withColumns({"first": month_number(F.col("since")), "last": F.coalesce(month_number(F.col("until")), F.lit(_FOREVER))})


def _parent_facts(spans: DataFrame) -> DataFrame:
    null = F.lit(None).cast("timestamp_ntz")
    whole_from = F.when(F.col("since") == _month_start(F.col("first")), F.col("first")).otherwise(F.col("first") + 1)
    fact = lambda kind, a, b, lo, hi, when: F.when(when, F.struct(F.lit(kind).alias("kind"), a.cast("int").alias("a"), b.cast("int").alias("b"), lo.alias("lo"), hi.alias("hi")))
    one = F.col("first") == F.col("last")
    facts = F.array_compact(F.array(
        fact(_ALL, whole_from, F.col("last") - 1, null, null, whole_from <= F.col("last") - 1),
        fact(_FROM, F.col("first"), F.col("first"), F.col("since"), null, ~one & (whole_from > F.col("first"))),
        fact(_UNTIL, F.col("last"), F.col("last"), null, F.col("until"), ~one & F.col("until").isNotNull() & (F.col("until") > _month_start(F.col("last")))),
        fact(_WITHIN, F.col("first"), F.col("first"), null, null, one),
    ))
    return (
        spans.select("key", F.explode(facts).alias("f")).groupBy("key", "f.kind", "f.a", "f.b")
        .agg(F.min("f.lo").alias("moment_from"), F.max("f.hi").alias("moment_until"), F.lit(0).cast("bigint").alias("n"))
    )


_NONE = np.zeros(0, np.int64)


def _slices(at: np.ndarray, month: np.ndarray) -> dict[int, np.ndarray]:
    """The positions ``at``, by month."""
    at = at[np.argsort(month[at], kind="stable")]
    cuts = np.flatnonzero(np.diff(month[at])) + 1
    return {int(month[p[0]]): p for p in np.split(at, cuts) if len(p)}


def _judge(heavy: int):
    """The verdict on each (key, month) of one range of keys that needs one, or that has more than ``heavy`` rows."""

    def run(table: pa.Table) -> pa.Table:
        codes, keys = _encode(table["key"])
        kind, a, b, n = (table[c].to_numpy() for c in ("kind", "a", "b", "n"))
        micros = lambda name: np.where(table[name].combine_chunks().is_null().to_numpy(zero_copy_only=False), 0, table[name].combine_chunks().cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False))
        lo, hi = micros("moment_from"), micros("moment_until")
        out: list[tuple] = []
        by_month = {k: _slices(np.flatnonzero(kind == k), a) for k in (_REF, _FROM, _UNTIL, _WITHIN)}
        lasting = np.flatnonzero(kind == _ALL)
        for month, refs in by_month[_REF].items():
            of = lambda k, month=month: by_month[k].get(month, _NONE)
            referred = Bitmap.of(codes[refs])
            whole = Bitmap.of(codes[lasting[(a[lasting] <= month) & (b[lasting] >= month)]])
            begins, ends, within = of(_FROM), of(_UNTIL), of(_WITHIN)
            part = Bitmap.of(codes[np.concatenate([begins, ends, within])])
            orphans = referred.and_not(whole | part).decode()
            check = (referred & part).and_not(whole).decode()
            rows = np.zeros(len(keys), np.int64)
            rows[codes[refs]] = n[refs]
            fine = np.flatnonzero(rows > heavy)
            fine = fine[~np.isin(fine, orphans) & ~np.isin(fine, check)]
            where = np.concatenate([orphans, check, fine])
            verdict = np.repeat([_ORPHAN, _CHECK, _OK], [len(orphans), len(check), len(fine)])

            def moment(facts, values, where=where):
                at, known = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
                at[codes[facts]], known[codes[facts]] = values[facts], True
                return pa.array(at[where], mask=~known[where]).cast(pa.timestamp("us"))

            inside = np.zeros(len(keys), bool)
            inside[codes[within]] = True
            out.append((keys.take(pa.array(where)), pa.array(np.full(len(where), month, np.int32)), pa.array(verdict.astype(np.int32)), moment(begins, lo), moment(ends, hi), pa.array(inside[where]), pa.array(rows[where])))
        names = _VERDICTS.names
        if not out:
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.timestamp("us"), pa.timestamp("us"), pa.bool_(), pa.int64()]
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names)
        return pa.concat_tables(pa.Table.from_arrays(list(x), names) for x in out)

    return run


def orphan_references(refs: DataFrame, row_id: str, key: str, at: str, parents: DataFrame, parent_key: str, since: str, until: str, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """The rows of ``refs`` that have an id for which no parent row was present at the row's time.

    A parent row is present from ``since`` on, until before ``until`` (null: for good).  Output: ``row_id``, ``key``
    (cleaned), ``at``, ``month`` (months since year 0).

    Ids are compared in lower case without surrounding blanks.  A null or blank id refers to nothing: never an orphan.
    A reference without a time cannot be judged and is left out; a parent without ``since``, or that ends no later than
    it begins, is never present.  Repeated rows give repeated results.  Without parents every reference is an orphan.
    Other columns are never read, so their names cannot clash.  ``heavy_rows`` is the least size of a (key, month) that is
    joined by broadcast; it decides how the work is split, never the result.
    """
    spark = refs.sparkSession
    n_refs = refs.count()
    blocks = blocks_for(spark, n_refs + parents.count())
    heavy = max(int(n_refs * SHARE), heavy_rows)
    rows = refs.select(F.col(row_id).alias("row_id"), clean_id(key).alias("key"), F.col(at).alias("at")).where("key is not null and at is not null").withColumn("month", month_number(F.col("at")))
    null = F.lit(None).cast("timestamp_ntz")
    ref_facts = rows.groupBy("key", "month").agg(F.count("*").alias("n")).select("key", F.lit(_REF).alias("kind"), F.col("month").alias("a"), F.col("month").alias("b"), null.alias("moment_from"), null.alias("moment_until"), "n")
    spans = _spans(parents, parent_key, since, until)
    facts = ref_facts.unionByName(_parent_facts(spans)).withColumn("range", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    verdicts, _ = materialise(facts.groupBy("range").applyInArrow(_judge(heavy), _VERDICTS), "verdicts")

    known = F.struct("verdict", "from", "until", "within").alias("v")
    large = verdicts.where(F.col("n") > heavy).select("key", "month", known)
    small = verdicts.where(F.col("n") <= heavy).select("key", "month", known)
    marked = rows.join(F.broadcast(large), ["key", "month"], "left")
    judged = marked.where("v is not null").unionByName(marked.where("v is null").drop("v").join(small, ["key", "month"]).select(*marked.columns))
    absent = F.coalesce(F.col("at") < F.col("v.from"), F.lit(True)) & F.coalesce(F.col("at") >= F.col("v.until"), F.lit(True))
    left = judged.where((F.col("v.verdict") == _ORPHAN) | ((F.col("v.verdict") == _CHECK) & absent)).select("row_id", "key", "at", "month", F.col("v.within").alias("within"))
    # kept as a table, so that what may lie within a span of its own month is found by the same pass as the rest
    left, _ = materialise(left, "left")
    inner = spans.where("first = last").select(F.col("key").alias("k"), F.col("first").alias("m"), "since", "until").distinct()
    covered = (F.col("key") == F.col("k")) & (F.col("month") == F.col("m")) & (F.col("at") >= F.col("since")) & (F.col("at") < F.col("until"))
    still = left.where("within").join(inner, covered, "left_anti")
    return left.where("not within").unionByName(still).select(F.col("row_id").alias(row_id), "key", F.col("at").alias(at), "month")


def month_of(orphans: DataFrame) -> Column:
    """``yyyy-MM`` of the rows of ``orphan_references``."""
    return month_text(F.col("month"))
