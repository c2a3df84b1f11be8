"""Evaluation texts that stand in training text, whole or in part.

The word n-grams of the test items are broadcast as one sorted hash table; every window of every document is
looked up in it, and documents with hits are verified by chaining the hits into stretches.  A document that
touches an item enough must touch some of its *anchors*, its n-grams without the commonest, so the commonest need
not be looked up.  Test sets too large to broadcast are met by a join on the anchors instead, still in one pass
over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.words import grams, hashed_words, owners
from quern.llm.prefixes import bloom_of, passes
from quern.session import cut, ensure_importable

GRAM = 3
#: Words of test items that are broadcast at most: about 40 bytes each.
BLOCK_WORDS = 2_000_000
#: Between two hits of one stretch: the most words apart, and the most that document and item may differ in that.
GAP, SHIFT = 6, 3
#: A stretch covers at least so many words of the item (or the whole of a shorter one), and hits this part of them.
LEAST, DENSE = 6, 0.7
#: A document is verified against an item when its hits touch this part of the item's grams.
TOUCHED = 0.15
#: So many touched anchors make a candidate (all that are needed, where fewer are).
AGREE = 3


def folded(text: pa.Array) -> pa.Array:
    """Texts without what does not matter: compatibility forms, marks, invisible characters, words broken at line ends."""
    text = pc.fill_null(text.cast(pa.string()), "")
    text = pc.replace_substring_regex(text, pattern=r"[\p{M}\p{Cf}]+", replacement="")
    text = pc.replace_substring_regex(text, pattern=r"(\p{L})[-\x{2010}\x{2011}\x{AD}][ \t]*\r?\n[ \t]*(\p{L})", replacement=r"\1\2")
    text = pc.utf8_normalize(text, form="NFKD")
    return pc.replace_substring_regex(text, pattern=r"[\p{M}\p{Cf}'’`]+", replacement="")


@dataclass
class Items:
    """Test items: words, grams by place with their order by hash, and the anchors sorted by hash."""

    ids: np.ndarray
    words: np.ndarray
    offsets: np.ndarray
    grams: np.ndarray  # of item i from offsets[i] on, as many as it has words less GRAM - 1
    by_hash: np.ndarray  # places of an item's grams in the order of their hashes, laid out as grams
    gram: np.ndarray
    item: np.ndarray
    times: np.ndarray  # places of an anchor in its item


def _needed(words: np.ndarray) -> np.ndarray:
    """The least number of touched places of items of so many words."""
    return np.maximum(1, np.ceil(TOUCHED * words - 1e-9)).astype(np.int64)


def item_block(ids: list[int], texts: list[str]) -> Items:
    words, offsets = hashed_words(folded(pa.array(texts, pa.string())))
    g, whole = grams(words, offsets, GRAM)
    rec = owners(offsets)
    by_hash = np.lexsort((g, ~whole, rec)) - offsets[:-1][rec] if len(rec) else rec
    at = np.flatnonzero(whole)
    _, code, count = np.unique(g[at], return_inverse=True, return_counts=True)
    # of each item's places the commonest are left out, as many as leave AGREE among those that must be touched
    order = np.lexsort((g[at], -count[code], rec[at]))
    at = at[order]
    first = np.searchsorted(rec[at], np.arange(len(ids)))
    need = _needed(np.diff(offsets))
    anchor = at[np.arange(len(at)) - first[rec[at]] >= (need - np.minimum(need, AGREE))[rec[at]]]
    both, times = np.unique(np.stack([g[anchor].view(np.int64), rec[anchor]], 1), axis=0, return_counts=True) if len(anchor) else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
    gram = np.ascontiguousarray(both[:, 0]).view(np.uint64)
    order = np.argsort(gram, kind="stable")
    return Items(np.array(ids, np.int64), words, offsets, g, by_hash, gram[order], both[order, 1], times[order])


def carried_words(doc: np.ndarray, item: np.ndarray, at_doc: np.ndarray, at_item: np.ndarray) -> int:
    """How many of the item's words lie in stretches that the document carries in the item's order.

    Hits are chained when both places advance by at most GAP words and by about as much; words between two hits
    of a stretch count as carried (a word changed here and there does not matter), unless more than DENSE of the
    stretch would be such words: then it only shares a pattern of speech.  Ends are drawn out over equal words.
    """
    order = np.lexsort((at_item, at_doc))
    covered = np.zeros(len(item), bool)
    open_: list[list[int]] = []  # of each stretch: first hit's item and doc place, last hit's, words hit
    done: list[list[int]] = []
    for d, i in zip(at_doc[order].tolist(), at_item[order].tolist()):
        best = None
        for s in open_:
            di, dd = i - s[2], d - s[3]
            if 0 < di <= GAP and 0 < dd <= GAP + SHIFT and abs(di - dd) <= SHIFT and (best is None or s[2] > best[2]):
                best = s
        if best:
            best[4] += min(GRAM, i - best[2])
            best[2], best[3] = i, d
        else:
            open_.append([i, d, i, d, GRAM])
        if len(open_) > 4:
            keep = []
            for s in open_:
                (keep if d - s[3] <= GAP + SHIFT else done).append(s)
            open_ = keep
    for i0, d0, i1, d1, hit in done + open_:
        i1, d1 = i1 + GRAM, d1 + GRAM
        if hit < DENSE * (i1 - i0):
            continue
        i0, d0 = _drawn_out(doc, item, i0 - 1, d0 - 1, -1)
        i1, d1 = _drawn_out(doc, item, i1, d1, 1)
        if i1 - i0 - 1 >= min(LEAST, len(item)):
            covered[max(i0 + 1, 0) : i1] = True
    return int(covered.sum())


def _drawn_out(doc: np.ndarray, item: np.ndarray, i: int, d: int, step: int) -> tuple[int, int]:
    """The first place beyond a stretch: goes on over equal words, and over up to two changed ones before an equal one."""
    while 0 <= i < len(item):
        for skip_i, skip_d in ((0, 0), (1, 1), (0, 1), (1, 0), (2, 2)):
            x, y = i + step * skip_i, d + step * skip_d
            if 0 <= x < len(item) and 0 <= y < len(doc) and item[x] == doc[y]:
                i, d = x + step, y + step
                break
        else:
            break
    return i, d


def _held(doc: np.ndarray, doc_grams: np.ndarray, whole: np.ndarray, items: Items, i: int) -> int:
    """How many of item i's words the document carries, 0 if it does not touch enough of it."""
    lo, hi = items.offsets[i], items.offsets[i + 1]
    many = int(hi - lo) - GRAM + 1
    if many <= 0:
        return 0
    places = items.by_hash[lo : lo + many]
    own = items.grams[lo + places]
    left = np.searchsorted(own, doc_grams, side="left")
    hit = whole & (left < many)
    hit[hit] = own[left[hit]] == doc_grams[hit]
    at = np.flatnonzero(hit)
    if not len(at):
        return 0
    times = np.searchsorted(own, doc_grams[at], side="right") - left[at]
    entry = np.repeat(left[at] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
    at_item = places[entry]
    if len(np.unique(at_item)) < _needed(hi - lo):
        return 0
    return carried_words(doc, items.words[lo:hi], np.repeat(at, times), at_item)


FOUND = "doc_id long, item_id long, carried int, item_words int"


def _batch(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "item_id", "carried", "item_words"])


def _scan(block, share: float) -> object:
    """Documents against the broadcast items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = block.value
        least = np.minimum(_needed(np.diff(items.offsets)), AGREE)
        for batch in batches:
            words, offsets = hashed_words(folded(batch.column(1)))
            g, whole = grams(words, offsets, GRAM)
            lo = np.searchsorted(items.gram, g, side="left")
            hit = whole & (lo < len(items.gram))
            hit[hit] = items.gram[lo[hit]] == g[hit]
            at = np.flatnonzero(hit)
            times = np.searchsorted(items.gram, g[at], side="right") - lo[at]
            entry = np.repeat(lo[at] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
            once = np.unique(owners(offsets)[np.repeat(at, times)] * max(1, len(items.gram)) + entry)
            doc, entry = once // max(1, len(items.gram)), once % max(1, len(items.gram))
            pairs, of = np.unique(doc * len(items.ids) + items.item[entry], return_inverse=True)
            touched = np.bincount(of, weights=items.times[entry], minlength=len(pairs))
            pairs = pairs[touched >= least[pairs % max(1, len(items.ids))]]
            rows: list[tuple[int, int, int, int]] = []
            for d, i in zip((pairs // max(1, len(items.ids))).tolist(), (pairs % max(1, len(items.ids))).tolist()):
                s = slice(offsets[d], offsets[d + 1])
                got, size = _held(words[s], g[s], whole[s], items, i), int(items.offsets[i + 1] - items.offsets[i])
                if got and got >= share * size:
                    rows.append((batch.column(0)[d].as_py(), int(items.ids[i]), got, size))
            yield _batch(rows)

    return run


def _pairs_held(share: float) -> object:
    """doc_id, text, item_id, item text of candidates -> what is carried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = item_block(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            words, offsets = hashed_words(folded(batch.column(1)))
            g, whole = grams(words, offsets, GRAM)
            rows = []
            for d, (doc, item) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                s = slice(offsets[d], offsets[d + 1])
                got, size = _held(words[s], g[s], whole[s], items, d), int(items.offsets[d + 1] - items.offsets[d])
                if got and got >= share * size:
                    rows.append((doc, item, got, size))
            yield _batch(rows)

    return run


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item_id, text -> item_id, words, place, gram."""
    for batch in batches:
        words, offsets = hashed_words(folded(batch.column(1)))
        g, whole = grams(words, offsets, GRAM)
        at, rec = np.flatnonzero(whole), owners(offsets)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rec[at])), pa.array(np.diff(offsets)[rec[at]]), pa.array(at - offsets[:-1][rec[at]]), pa.array(g[at].view(np.int64))], names=["item_id", "words", "place", "gram"])


def _doc_grams(bloom) -> object:
    """doc_id, text -> doc_id, gram: the document's distinct grams that may be anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, offsets = hashed_words(folded(batch.column(1)))
            g, whole = grams(words, offsets, GRAM)
            at = np.flatnonzero(whole)
            at = at[passes(bloom.value, g[at].view(np.int64))]
            both = np.unique(np.stack([owners(offsets)[at], g[at].view(np.int64)], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(both[:, 0])), pa.array(both[:, 1])], names=["doc_id", "gram"])

    return run


def _by_join(docs: DataFrame, items: DataFrame, share: float) -> DataFrame:
    """The same as the broadcast scan for items of any number: documents meet items by a join on their anchors."""
    spark = docs.sparkSession
    items = items.withColumn("k", F.xxhash64("item_id", "text"))
    placed = cut(items.select("k", "text").mapInArrow(_gram_rows, "item_id long, words long, place long, gram long").withColumnRenamed("item_id", "k"))
    common = placed.groupBy("gram").agg(F.count("*").alias("often"))
    order = Window.partitionBy("k").orderBy(F.desc("often"), "gram", "place")
    need = F.expr(f"greatest(1, ceil({TOUCHED} * words - 1e-9))")
    least = F.least(need, F.lit(AGREE))
    rest = placed.join(common, "gram").withColumn("n", F.row_number().over(order)).where(F.col("n") > need - least)
    anchors = cut(rest.groupBy("gram", "k").agg(F.count("*").alias("times"), F.max(least).alias("least")))
    bloom = spark.sparkContext.broadcast(bloom_of(anchors.select(F.col("gram").alias("id"))))
    met = docs.mapInArrow(_doc_grams(bloom), "doc_id long, gram long").distinct().join(anchors, "gram").groupBy("doc_id", "k").agg(F.sum("times").alias("touched"), F.max("least").alias("least")).where("touched >= least").select("doc_id", "k")
    pairs = met.join(docs, "doc_id").join(items.withColumnRenamed("text", "item_text"), "k").select("doc_id", "text", "item_id", "item_text")
    return pairs.mapInArrow(_pairs_held(share), FOUND)


def standing_sentences(items: DataFrame, text: str = "text", least: int = 3, share: float = 0.02) -> list[str]:
    """First sentences with which at least ``least`` items and ``share`` of all items begin, counted over all items."""
    first = items.where(F.col(text).isNotNull()).select(F.regexp_extract(F.col(text), r"(?s)^\s*(.{10,}?[.!?:])\s", 1).alias("s"))
    counted = first.groupBy("s").count()
    total = items.count()
    return [r.s for r in counted.where((F.col("s") != "") & (F.col("count") >= max(least, share * total))).collect()]


def without_standing(rows: list[tuple[int, str]], sentences: list[str]) -> list[tuple[int, str]]:
    """The items without the standing sentences they begin with; an item that is nothing else stays whole."""
    out = []
    for key, text in rows:
        core = text.lstrip()
        for s in sorted(sentences, key=len, reverse=True):
            if core.startswith(s) and core[len(s) :].strip():
                core = core[len(s) :]
                break
        out.append((key, core))
    return out


def leaked_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", share: float = 0.5, most_broadcast: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, carried, item_words): the documents that carry at least ``share`` of the words of an item.

    Null, empty and wordless texts and items carry nothing; items under LEAST words are found only whole; repeated
    documents and items count once; further columns are ignored.  Items of ``most_broadcast`` words and more in all
    are joined instead of broadcast, with the same result.
    """
    spark = docs.sparkSession
    ensure_importable(spark)
    sentences = standing_sentences(items, item_text)
    part = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    chosen = items.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null").distinct()

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = without_standing(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), sentences)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["item_id", "text"])

    chosen = chosen.mapInArrow(strip, "item_id long, text string")
    size = items.agg(F.sum(F.length(item_text))).first()[0] or 0
    if size // 4 < most_broadcast:
        rows = chosen.collect()
        block = spark.sparkContext.broadcast(item_block([r.item_id for r in rows], [r.text for r in rows]))
        found = part.mapInArrow(_scan(block, share), FOUND)
    else:
        found = _by_join(part, cut(chosen), share)
    return found.groupBy("doc_id", "item_id").agg(F.max("carried").alias("carried"), F.max("item_words").alias("item_words"))


def cleaned_corpus(docs: DataFrame, items: DataFrame, key: str = "doc_id", **kw) -> DataFrame:
    """``docs`` without the documents that carry test items."""
    bad = leaked_items(docs, items, key=key, **kw).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(bad, key, "left_anti")
