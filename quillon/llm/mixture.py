"""Mixing sources to target shares of all tokens.

Tokens are summed per source, repetition rates follow from the sums, and every document is then emitted
``floor(rate)`` times plus once more with probability ``rate - floor(rate)``, drawn from a seeded hash of its id.  The
draw depends on nothing but the id and the seed, so the mix is the same on every cluster, split and retry.

Sources stay a table from end to end, however many there are: only sums over them reach the driver.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.plans.skew import join_unique
from quillon.runtime import materialise, ship_code, ship_files

#: The vocabulary's file, and the pattern that splits a text before byte pairs are merged.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Sources whose rates are broadcast to the documents, a few dozen bytes each; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: Tokens of all documents of the targeted sources, as the size of a mix.
TARGETED = "targeted"
#: Characters encoded at a time; longer texts are cut where a blank follows a non-blank, which leaves the count as it is.
PIECE = 100_000
_encodings: dict[str, tiktoken.Encoding] = {}


def source_name(column: str | Column) -> Column:
    """A source in one spelling: lower case, no blanks around it, ``_`` for blanks and hyphens within; blank is null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(c), r"^\s+|\s+$", ""), r"[\s\-_]+", "_"), F.lit(""))


def _encoding(path: str) -> tiktoken.Encoding:
    if path not in _encodings:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def _tokens(encoding: tiktoken.Encoding, text: str) -> int:
    n = lo = 0
    while len(text) - lo > PIECE:
        cut = lo + PIECE
        while cut < len(text) and not (text[cut] == " " and not text[cut - 1].isspace()):
            cut += 1
        n += len(encoding.encode_ordinary(text[lo:cut]))
        lo = cut
    return n + len(encoding.encode_ordinary(text[lo:]))


def count_tokens(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of ``documents``; the source in one spelling, null texts have no tokens."""

    name = ship_files(documents.sparkSession, vocabulary)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(SparkFiles.get(name))
        for batch in batches:
            counts = np.fromiter((_tokens(encoding, t.as_py()) if t.is_valid else 0 for t in batch.column(2)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts)], ["doc_id", "source", "n_tokens"])

    ship_code(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), source_name("source").alias("source"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id bigint, source string, n_tokens bigint")


def rates(sources: DataFrame, total: float | str | None = None) -> tuple[DataFrame, float]:
    """``sources`` (source, target_share, max_copies, tokens) with ``rate``, and the mix's size in tokens.

    The default size is the largest at which every source that has documents has its share; ``TARGETED`` is that of all
    documents of these sources.  Targets count relative to the sum of those that have documents.  A source that cannot
    give its share within ``max_copies`` gives all it can; what it falls short of goes to the others in proportion to
    their targets, again and again until all fit.
    """
    target = F.when(F.col("target_share") > 0, F.nanvl("target_share", F.lit(0.0))).otherwise(0.0)
    cap = F.col("tokens") * F.coalesce("max_copies", F.lit(0))
    # a source is full where more than cap / target tokens are given for a unit of target
    usable = sources.withColumns({"_cap": cap.cast("double"), "_target": target}).withColumn("_full", F.when((F.col("_target") > 0) & (F.col("_cap") > 0), F.col("_cap") / F.col("_target")))
    open_ = usable.where("_full is not null")
    weight, least, most, tokens = open_.agg(F.sum("_target"), F.min("_full"), F.sum("_cap"), F.sum("tokens")).first()
    weight, least, most = weight or 0.0, least or 0.0, most or 0.0
    size = least * weight if total is None else float(tokens or 0) if total == TARGETED else float(total)
    level, before = (size / weight if weight else 0.0), -1.0
    while level > before and size < most:
        before = level
        full, rest = open_.agg(F.sum(F.when(F.col("_full") < level * (1 - 1e-12), F.col("_cap"))), F.sum(F.when(F.col("_full") >= level * (1 - 1e-12), F.col("_target")))).first()
        if not rest:
            break
        level = max(level, (size - (full or 0.0)) / rest)
    whole = F.col("_full") <= F.lit(level * (1 + 1e-12)) if size < most else F.col("_full").isNotNull()
    rate = F.when(whole, F.col("max_copies").cast("double")).when(F.col("_full").isNotNull(), F.lit(level) * F.col("_target") / F.col("tokens")).otherwise(0.0)
    return usable.withColumn("rate", rate).drop("_cap", "_target", "_full"), size


def plan(counted: DataFrame, targets: DataFrame, total: float | str | None = None) -> tuple[DataFrame, float]:
    """The sources of ``targets`` (source, target_share, max_copies) with their tokens and rates, and the mix's size."""
    wanted = targets.select(source_name("source").alias("source"), F.col("target_share").cast("double"), F.col("max_copies").cast("int")).where("source is not null")
    wanted = wanted.groupBy("source").agg(F.max(F.nanvl("target_share", F.lit(None).cast("double"))).alias("target_share"), F.max("max_copies").alias("max_copies"))
    tokens = counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    # join_unique is not needed here: both sides have a row a source
    sources, _ = materialise(wanted.join(tokens, "source", "left").na.fill(0, ["tokens"]), "sources")
    found, size = rates(sources, total)
    return found, size


def _rated(df: DataFrame, sources: DataFrame, rows: int, seed: int) -> DataFrame:
    """``df`` (doc_id, source, ...) with ``times``, of the documents that are used at all: ``floor(rate)``, and once more by
    the hash of the id."""
    used = sources.where("rate > 0").select("source", "rate")
    joined = df.join(F.broadcast(used), "source") if used.count() <= BROADCAST_SOURCES else join_unique(df, used, "source", rows)
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 53)) / F.lit(float(1 << 53))
    times = (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    return joined.withColumn("times", times).where("times > 0").drop("rate")


def mix(documents: DataFrame, targets: DataFrame, total: float | str | None = None, seed: int = 0, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The mix (doc_id, source, copy_no, text) and its report.

    ``documents`` has ``doc_id, source, text``; ``targets`` has ``source, target_share, max_copies``.  Sources are
    compared in one spelling.  Documents of other or no sources are not used; null and blank texts have no tokens but
    are used like the others of their source.  No document is used more than ``max_copies`` times.  A source with no
    documents, a null, NaN or non-positive share, or no allowed copy gets nothing.  A source named twice in ``targets``
    counts with its greatest share and copies.  Copies of a text under other ids are different documents; a repeated
    ``doc_id`` is drawn alike each time.  Without targets or documents the mix is empty.

    The report has a row per source of ``targets``: ``source``, ``target_share`` as given, ``wanted_share`` (relative to
    the targets' sum), ``source_tokens``, ``rate``, ``max_copies``, ``n_copies`` and ``mixed_tokens`` (as drawn),
    ``actual_share``, and ``missing_tokens``: what the source falls short of its wanted share of the mix's size.

    Without ``total`` the mix is the largest in which every source that has documents has its share, so one tiny source
    with few allowed copies makes it small; a given ``total``, such as ``TARGETED``, is reached by the other sources
    instead.
    """
    counted, _ = materialise(count_tokens(documents, vocabulary), "tokens")
    rows = counted.count()
    sources, size = plan(counted, targets, total)
    read = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), source_name("source").alias("source"), F.col("text"))
    mixed = _rated(read, sources, rows, seed).withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc_id", "source", "copy_no", "text")

    drawn = _rated(counted, sources, rows, seed).groupBy("source").agg(F.sum("times").cast("bigint").alias("n_copies"), F.sum(F.col("times") * F.col("n_tokens")).alias("mixed_tokens"))
    drawn, _ = materialise(drawn, "drawn")
    all_tokens = drawn.agg(F.sum("mixed_tokens")).first()[0] or 0
    whole = sources.agg(F.sum(F.when(F.col("target_share") > 0, F.col("target_share")))).first()[0] or 1.0
    report = sources.withColumnRenamed("tokens", "source_tokens").withColumn("wanted_share", F.coalesce("target_share", F.lit(0.0)) / F.lit(whole)).join(drawn, "source", "left").na.fill(0, ["n_copies", "mixed_tokens"])
    missing = F.greatest(F.lit(0.0), F.col("wanted_share") * F.lit(size) - F.col("rate") * F.col("source_tokens"))
    report = report.withColumns({"actual_share": F.col("mixed_tokens") / F.lit(float(all_tokens or 1)), "missing_tokens": missing})
    return mixed, report.select("source", "target_share", "wanted_share", "source_tokens", "rate", "max_copies", "n_copies", "mixed_tokens", "actual_share", "missing_tokens")
