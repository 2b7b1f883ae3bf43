"""Totals per key when a few keys hold most records.

No task ever receives a whole key.  Rows are first made distinct per (key, counted id), a shuffle whose key includes
the id and so spreads every large key evenly.  Each equal split then dictionary-encodes its keys and adds its rows into
dense arrays, one slot per key (``numpy.bincount``, ``minimum.at``, ``maximum.at``).  The arrays leave the split in
blocks of the key space; a large key costs one slot a split.  Blocks are summed slot by slot in a second, small shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.columns import clean_id
from quillon.runtime import blocks_for

#: Rows that a split accumulates before it hands its arrays on; bounds a task's memory.
SPLIT_ROWS = 500_000
_LATE, _EARLY = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def _encode(keys: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Dense codes of the keys and the dictionary that decodes them."""
    array = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.string())
    encoded = array.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


def _split_arrays(measures: int):
    """Adds a split's rows into dense arrays and emits them cut by block."""

    def emit(table: pa.Table) -> pa.RecordBatch:
        codes, keys = _encode(table["k"])
        k = len(keys)
        what = table["what"].to_numpy()
        has = ~table["one"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
        first, last = np.full(k, _LATE), np.full(k, _EARLY)
        for name, into, fold in (("lo", first, np.minimum), ("hi", last, np.maximum)):
            t = table[name].combine_chunks()
            known = ~t.is_null().to_numpy(zero_copy_only=False)
            fold.at(into, codes[known], t.drop_null().cast(pa.int64()).to_numpy(zero_copy_only=False))
        block = np.zeros(k, np.int32)
        block[codes] = table["block"].to_numpy()
        order = np.argsort(block, kind="stable")
        names, starts = np.unique(block[order], return_index=True)
        offsets = pa.array(np.append(starts, k).astype(np.int32))
        as_list = lambda values: pa.ListArray.from_arrays(offsets, values)
        counts = [np.bincount(codes[has & (what == m)], minlength=k)[order] for m in range(measures)]
        return pa.RecordBatch.from_arrays(
            [pa.array(names), as_list(keys.take(pa.array(order))), as_list(pa.array(first[order])), as_list(pa.array(last[order])), *(as_list(pa.array(c)) for c in counts)],
            ["block", "k", "first", "last", *(f"n{m}" for m in range(measures))],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= SPLIT_ROWS:
                yield emit(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield emit(pa.Table.from_batches(held))

    return run


def _sum_blocks(measures: int):
    """Adds the arrays of one block, slot by slot."""

    def run(table: pa.Table) -> pa.Table:
        flat = lambda name: pa.concat_arrays([c.flatten() for c in table[name].chunks])
        codes, keys = _encode(flat("k"))
        k = len(keys)
        first, last = np.full(k, _LATE), np.full(k, _EARLY)
        np.minimum.at(first, codes, flat("first").to_numpy())
        np.maximum.at(last, codes, flat("last").to_numpy())
        counts = []
        for m in range(measures):
            total = np.zeros(k, np.int64)
            np.add.at(total, codes, flat(f"n{m}").to_numpy())
            counts.append(pa.array(total))
        stamp = pa.timestamp("us")
        times = [pa.array(first, mask=first == _LATE).cast(stamp), pa.array(last, mask=last == _EARLY).cast(stamp)]
        return pa.Table.from_arrays([keys, *counts, *times], ["k", *(f"n{m}" for m in range(measures)), "first", "last"])

    return run


def key_totals(df: DataFrame, key: str, counted: dict[str, str], at: str, out_key: str | None = None) -> DataFrame:
    """One row per key: distinct ids of each counted column, first and last time.

    ``counted`` maps an output name to the id column whose distinct values are counted; ``at`` is a timestamp without
    zone.  Output: ``out_key`` (default ``key``), the counts as bigint, ``first_<at>``, ``last_<at>``.

    Keys and ids are compared in lower case without surrounding blanks.  Rows whose key is null or blank belong to no
    key and are left out; null or blank ids count nowhere but their rows' times do; repeated rows count once; null
    times are passed over (all null: null); an empty table gives no rows.  Columns not named here are never read, so
    their names cannot clash.
    """
    spark = df.sparkSession
    blocks = blocks_for(spark, df.count() * len(counted))
    one: list[Column] = [F.struct(F.lit(m).alias("what"), clean_id(c).alias("one")) for m, c in enumerate(counted.values())]
    long = (
        df.select(clean_id(key).alias("k"), F.col(at).alias("t"), F.explode(F.array(*one)).alias("m"))
        .where(F.col("k").isNotNull() & ((F.col("m.what") == 0) | F.col("m.one").isNotNull()))
        .groupBy("k", F.col("m.what").alias("what"), F.col("m.one").alias("one"))
        .agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
        .withColumn("block", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"))
    )
    n = len(counted)
    longs = [T.StructField(f"n{m}", T.ArrayType(T.LongType())) for m in range(n)]
    arrays = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("k", T.ArrayType(T.StringType())), T.StructField("first", T.ArrayType(T.LongType())), T.StructField("last", T.ArrayType(T.LongType())), *longs])
    sums = T.StructType([T.StructField("k", T.StringType()), *(T.StructField(f"n{m}", T.LongType()) for m in range(n)), T.StructField("first", T.TimestampNTZType()), T.StructField("last", T.TimestampNTZType())])
    totals = long.mapInArrow(_split_arrays(n), arrays).groupBy("block").applyInArrow(_sum_blocks(n), sums)
    named = [F.col(f"n{m}").alias(name) for m, name in enumerate(counted)]
    return totals.select(F.col("k").alias(out_key or key), *named, F.col("first").alias(f"first_{at}"), F.col("last").alias(f"last_{at}"))


def distinct_ids(df: DataFrame, column: str) -> int:
    """How many different ids a column holds; one number reaches the driver."""
    return df.select(F.countDistinct(clean_id(column))).first()[0]


def large_keys(df: DataFrame, key: str, counted: str, at: str, percent: float) -> DataFrame:
    """The keys that hold at least ``percent`` of all distinct ids of ``counted``; rows as of ``key_totals``.

    With no ids at all there are no large keys.
    """
    least = distinct_ids(df, counted) * percent
    return key_totals(df, key, {"n_ids": counted}, at).where((F.col("n_ids") * 100 >= F.lit(least)) & (F.col("n_ids") > 0))
