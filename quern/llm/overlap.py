"""Records that stand in the training split and in an evaluation split, by content-defined chunks.

The pairs of training and evaluation records that are alike come from ``prefixes.alike``, which loses none.  For
their overlap, a rolling hash over ``window`` words cuts both records; the lengths of the chunks that the two
share are summed into overlap fractions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.words import bag_ids, hashed_words, list_column, mix, owners
from quern.llm.prefixes import alike
from quern.session import cut

Chunks = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]

_GOLD = np.uint64(0x9E3779B97F4A7C15)

# The names of the splits.
SPLIT_NAMES = {
    "train": ["train", "training"],
    "validation": ["validation", "valid", "val", "dev"],
    "test": ["test", "testing", "holdout"],
}


def split_name(col: Column | str) -> Column:
    """train, validation or test; null for no split or an unknown one.  Case and blanks around do not matter."""
    raw = F.lower(F.regexp_replace(F.col(col) if isinstance(col, str) else col, r"(?U)^\s+|\s+$", ""))
    out = F.lit(None).cast("string")
    for name, spelled in SPLIT_NAMES.items():
        out = F.when(raw.isin(spelled), F.lit(name)).otherwise(out)
    return out


def content_chunks(window: int = 2, rate: int = 3, longest: int = 16) -> Chunks:
    """(digest, record, number of words) of content-defined chunks.

    A chunk ends after a word where the hash of the last ``window`` words is divisible by ``rate`` (on average
    every ``rate`` words), or after ``longest`` words.
    """

    def chunks(words: np.ndarray, offsets: np.ndarray):
        n_all = np.diff(offsets)
        rec = owners(offsets)
        total = len(words)
        if not total:
            e = np.zeros(0, np.int64)
            return e, e, e
        pos = np.arange(total)
        roll = np.zeros(total, np.uint64)
        for k in range(window):
            back = np.maximum(pos - k, 0)
            roll = mix(roll * np.uint64(3) + np.where(pos - k >= offsets[rec], words[back], np.uint64(0)))
        first = np.zeros(total, bool)
        first[offsets[:-1][n_all > 0]] = True
        cut_after = roll % np.uint64(rate) == 0
        begins = first.copy()
        begins[1:] |= cut_after[:-1]
        at = np.flatnonzero(begins)
        within = pos - np.repeat(at, np.diff(np.append(at, total)))
        begins |= within % longest == 0
        at = np.flatnonzero(begins)
        size = np.diff(np.append(at, total))
        within = pos - np.repeat(at, size)
        digest = mix(np.add.reduceat(mix(words + _GOLD * (within + 1).astype(np.uint64)), at) + size.astype(np.uint64))
        return digest.view(np.int64), rec[at], size

    return chunks


def _chunk_rows(chunks: Chunks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """row, text -> row, chunks: an array of (digest, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, offsets = hashed_words(batch.column(1))
            digest, rec, size = chunks(words, offsets)
            upto = np.searchsorted(rec, np.arange(len(offsets)))
            yield pa.RecordBatch.from_arrays([batch.column(0), list_column(digest, upto, pa.int64()), list_column(size, upto, pa.int64())], names=["row", "digests", "sizes"])

    return run


def _shared_words(found: DataFrame, texts: DataFrame) -> DataFrame:
    """(train_id, eval_id, shared_words): the words of the evaluation record in chunks that the training record has too.

    Of rows that repeat an id with another text, the most counts.
    """
    sides = []
    for side, name in ((0, "train_id"), (1, "eval_id")):
        own = texts.where(F.col("side") == side).join(found.select(F.col(name).alias("row")).distinct(), "row", "left_semi").select("row", "text")
        sides.append(own.mapInArrow(_chunk_rows(content_chunks()), "row long, digests array<long>, sizes array<long>").select(F.col("row").alias(name), F.col("digests").alias(f"d{side}"), F.col("sizes").alias(f"s{side}")))
    common = F.aggregate(F.arrays_zip("d1", "s1"), F.lit(0).cast("long"), lambda total, c: total + F.when(F.array_contains("d0", c["d1"]), c["s1"]).otherwise(F.lit(0).cast("long")))
    return found.distinct().join(sides[0], "train_id").join(sides[1], "eval_id").groupBy("train_id", "eval_id").agg(F.max(common).alias("shared_words"))


def cross_split_overlap(records: DataFrame, key: str = "record_id", split: str = "split", text: str = "output", percent: int = 85) -> DataFrame:
    """(train_id, eval_id, eval_split, shared_words, overlap, likeness): all pairs whose likeness is at least ``percent`` / 100.

    ``overlap`` is the part of the evaluation record's words that lie in chunks shared with the training record.
    Exact copies have overlap and likeness 1.  Rows with a null key or without a split have no pairs, nor have
    texts without a word; repeated rows count once; further columns are ignored.
    """
    named = records.select(F.col(key).cast("long").alias("row"), split_name(split).alias("split"), F.col(text).alias("text")).where("row is not null and split is not null")
    sides = named.withColumn("side", F.when(F.col("split") == "train", 0).otherwise(F.when(F.col("split") == "validation", 1).otherwise(3)).cast("byte"))
    # bit 0 of side tells train from evaluation; the postings need no more
    texts = sides.select("row", (F.col("side").bitwiseAND(1)).cast("byte").alias("side"), "text")
    pairs, members = alike(texts, percent, cross=True)
    splits = sides.where("side != 0").select(F.col("row").alias("eval_id"), F.col("split").alias("eval_split")).distinct()
    train = members.where("side = 0").select(F.col("row").alias("train_id"), F.col("id").alias("a"))
    held = members.where("side = 1").select(F.col("row").alias("eval_id"), F.col("id").alias("b"))
    found = cut(pairs.join(train, "a").join(held, "b").select("train_id", "eval_id", "n_b", (F.col("common") / F.greatest("n_a", "n_b")).alias("likeness")))
    shared = _shared_words(found.select("train_id", "eval_id"), texts)
    between = found.join(shared, ["train_id", "eval_id"]).select("train_id", "eval_id", "shared_words", F.least(F.lit(1.0), F.col("shared_words") / F.col("n_b")).alias("overlap"), "likeness")
    copies = (
        members.where("side = 0").select(F.col("row").alias("train_id"), "id", F.col("n").cast("long").alias("shared_words"))
        .join(members.where("side = 1").select(F.col("row").alias("eval_id"), "id"), "id")
        .select("train_id", "eval_id", "shared_words", F.lit(1.0).alias("overlap"), F.lit(1.0).alias("likeness"))
    )
    return between.unionByName(copies).where("train_id != eval_id").join(splits, "eval_id").dropDuplicates(["train_id", "eval_id"]).select("train_id", "eval_id", "eval_split", "shared_words", "overlap", "likeness")


def overlap_pairs(records: DataFrame, **kw) -> DataFrame:
    """(record_id_a, record_id_b; the smaller first) of ``cross_split_overlap``."""
    return cross_split_overlap(records, **kw).select(F.least("train_id", "eval_id").alias("record_id_a"), F.greatest("train_id", "eval_id").alias("record_id_b")).distinct()


def overlap_report(records: DataFrame, context: str = "base_context_id", key: str = "record_id", split: str = "split", **kw) -> DataFrame:
    """(split, base_context_id, leaking_records, pairs): the overlaps counted by evaluation split and source."""
    found = cross_split_overlap(records, key=key, split=split, **kw)
    ctx = records.select(F.col(key).cast("long").alias("eval_id"), F.coalesce(F.lower(F.trim(F.col(context))), F.lit("")).alias("base_context_id")).groupBy("eval_id").agg(F.min("base_context_id").alias("base_context_id"))
    return (
        found.join(ctx, "eval_id")
        .groupBy(F.col("eval_split").alias("split"), "base_context_id")
        .agg(F.countDistinct("eval_id").alias("leaking_records"), F.count("*").alias("pairs"))
    )
