"""Pairs of alike texts by prefixes of their rarest words: exact, whatever the order of the words.

1. A text is the set of its *numbered words* (each word with its how-manieth occurrence), put into one order for
   all texts: rarest first, by a table of fixed size of the counts in all texts.
2. Two texts of n and m words are alike if they have at least T = ceil(percent / 100 * max(n, m)) numbered words in
   common.  Then the first common word stands among the first n - T + 1 of the one and m - T + 1 of the other, and the
   second among one more.  Every text is posted under each word of its prefix; under a frequent word once, with 32 bits
   of each later word of the longer prefix, and texts meet there only if they share one of these too.
3. Lists are merged whole, however long.  A pair passes if the parities of its words (SIGNATURE bits) differ in no more
   places than the likeness allows and its places in the list leave room for T common words; neither test can drop
   an alike pair.
4. Every candidate is verified by its whole word sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.words import bag_ids, coded_words, list_column, mix, number, numbered_codes, owners
from quern.session import cut, ensure_importable

#: Longs of a text's parity signature.
SIGNATURE = 3
POSTING = "key long, id long, mark long, " + ", ".join(f"s{k} long" for k in range(SIGNATURE)) + ", seconds array<int>"
#: Buckets of the counts (8 MB), texts from which on a word is frequent.
BUCKET_BITS, FREQUENT = 21, 1024
#: Texts from which on the postings of a frequent word go under several keys, by their seconds.
KEY_ROWS = 1_000_000
#: Postings that a task merges at once, if they are not all of one key; pairs that it makes at once, which stay in
#: the processor's cache; pairs found that it hands on at once.
MERGED_ROWS, BLOCK_PAIRS, FOUND_PAIRS = 1 << 17, 1 << 15, 1 << 20
#: Distinct numbered words of a batch up to which they are told apart by a table.
MANY_KINDS = 1 << 24
#: Bits of the Bloom filter of candidate ids (8 MB); beyond some 10 million candidates it lets more pass, no less.
BLOOM_BITS = 1 << 26
#: ``mark`` holds a posting's number of words, its place and its side.
_N, _PLACE = 25, 1


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (mix(tokens.view(np.uint64)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _counts(texts: DataFrame) -> np.ndarray:
    """The numbered words of all ``texts`` by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            table, codes, offsets = coded_words(batch.column(0))
            codes, nth = numbered_codes(codes, len(table), offsets)
            own += np.bincount(_bucket(number(table[codes], nth)), minlength=1 << BUCKET_BITS)
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[at])], names=["at", "n"])

    rows = texts.select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << BUCKET_BITS, np.int32)
    out[np.asarray(rows["at"])] = np.minimum(np.asarray(rows["n"]), 2**31 - 1)
    return out


def signatures(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The parity of each record's numbered words in each of 64 * SIGNATURE places, as SIGNATURE longs a record."""
    h = mix(tokens.view(np.uint64) + np.uint64(1))
    bit, word = np.left_shift(np.uint64(1), h & np.uint64(63)), (h >> np.uint64(6)) % np.uint64(SIGNATURE)
    out = np.zeros((len(offsets) - 1, SIGNATURE), np.uint64)
    for k in range(SIGNATURE):
        upto = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(np.where(word == k, bit, np.uint64(0)))])
        out[:, k] = upto[offsets[1:]] ^ upto[offsets[:-1]]
    return out.view(np.int64)


def rarest_first(table: np.ndarray, codes: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbered words of each record, their counts), rarest first; equal counts by the word, the same for all records."""
    codes, nth = numbered_codes(codes, len(table), offsets)
    at = codes + len(table) * nth
    kinds = len(table) * (int(nth.max(initial=0)) + 1)
    if kinds <= MANY_KINDS:
        met = np.zeros(kinds, bool)
        met[at] = True
        ids = np.flatnonzero(met)
        place = np.zeros(kinds, np.int64)
        place[ids] = np.arange(len(ids))
        at = place[at]
    else:
        ids, at = np.unique(at, return_inverse=True)
    tokens = number(table[ids % max(1, len(table))], ids // max(1, len(table)))
    count = counts[_bucket(tokens)].astype(np.int64)
    order = np.lexsort((tokens, count))
    rank = np.zeros(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    base = owners(offsets) * len(ids)
    rank = np.sort(base + rank[at]) - base
    return tokens[order][rank], count[order][rank]


def prefix_rows(tokens: np.ndarray, count: np.ndarray, offsets: np.ndarray, frequent: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, record, place, seconds, offsets of the seconds) of the postings of words ``rarest_first``.

    A rare word has no seconds; a frequent one has 32 bits of each later word of the longer prefix, over several keys
    if more than KEY_ROWS texts may have it.  Texts of one word resemble only their copies and have none.
    """
    n, rec = np.diff(offsets), owners(offsets)
    place = np.arange(len(tokens)) - offsets[:-1][rec]
    last = (n - (n * percent + 99) // 100)[rec]
    inside = (place <= last) & (n[rec] > 1)
    often = inside & (count > frequent)
    one, two = np.flatnonzero(inside & ~often), np.flatnonzero(often)
    many = (last - place)[two] + 1
    first = np.repeat(two, many)
    second = tokens[first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(many) - many, many)].view(np.uint64)
    keys = (count[first] // KEY_ROWS + 1).astype(np.uint64)
    part = mix(second) % keys
    if (keys > 1).any():
        order = np.lexsort((part, first))
        first, second, part = first[order], second[order], part[order]
    new = np.concatenate([np.ones(min(1, len(first)), bool), (first[1:] != first[:-1]) | (part[1:] != part[:-1])])
    at = np.flatnonzero(new)
    key = np.concatenate([mix(tokens[one].view(np.uint64)), mix(tokens[first[at]].view(np.uint64) * np.uint64(3) + part[at])])
    own = np.concatenate([one, first[at]])
    upto = np.concatenate([np.zeros(len(one), np.int64), at, [len(first)]])
    return key.view(np.int64), rec[own], place[own], (second & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), upto


def _postings(counts, frequent: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """side, text -> postings; copies within a batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, codes, offsets = coded_words(batch.column(1))
            side = np.asarray(batch.column(0)).astype(np.int64)
            bags = bag_ids(table[codes], offsets)
            order = np.lexsort((side, bags))
            new = np.ones(len(order), bool)
            new[1:] = (bags[order][1:] != bags[order][:-1]) | (side[order][1:] != side[order][:-1])
            keep = np.zeros(len(order), bool)
            keep[order[new]] = True
            n = np.diff(offsets)
            codes, side, bags, n = codes[np.repeat(keep, n)], side[keep], bags[keep], n[keep]
            offsets = np.concatenate([[0], np.cumsum(n)])
            tokens, count = rarest_first(table, codes, offsets, counts.value)
            sig = signatures(tokens, offsets)
            key, rec, place, seconds, upto = prefix_rows(tokens, count, offsets, frequent, percent)
            mark = (n[rec] << _N) | (place << _PLACE) | side[rec]
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (key, bags[rec], mark, *sig[rec].T)), list_column(seconds, upto, pa.int32())], names=[x.split()[0] for x in POSTING.split(", ")])

    return run


def _fitting(x: np.ndarray, y: np.ndarray, cols: list[np.ndarray], cross: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of the postings x, y that may be alike; with ``cross`` of two sides, the one of side 0 first."""
    a, b, mark_a, mark_b = cols[1][x], cols[1][y], cols[2][x], cols[2][y]
    n, m = mark_a >> _N, mark_b >> _N
    places = (1 << (_N - _PLACE)) - 1
    room = np.minimum(n - ((mark_a >> _PLACE) & places), m - ((mark_b >> _PLACE) & places))
    need = (np.maximum(n, m) * percent + 99) // 100
    apart = np.zeros(len(x), np.int64)
    for s in cols[3:]:
        apart += np.bitwise_count((s[x] ^ s[y]).view(np.uint64))
    keep = (room >= need) & (apart <= n + m - 2 * need) & (a != b)
    if cross:
        keep &= (mark_a & 1) != (mark_b & 1)
    swap = ((mark_a & 1) > (mark_b & 1)) if cross else (a > b)
    return np.where(swap, b, a)[keep], np.where(swap, a, b)[keep]


def _near(rows: np.ndarray, others: np.ndarray, sigs: list[np.ndarray], most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, y): the postings ``rows`` (lists x i) and ``others`` (lists x j) of each list whose signatures are near enough.

    Sums of 256 wrap to 0, which lets a pair pass.
    """
    apart = np.zeros((*rows.shape, others.shape[1]), np.uint8)
    wide, narrow = np.empty(apart.shape, np.uint64), np.empty(apart.shape, np.uint8)
    for s in sigs:
        np.bitwise_xor(s[rows][:, :, None], s[others][:, None, :], out=wide)
        np.bitwise_count(wide, out=narrow)
        apart += narrow
    at = np.flatnonzero(apart <= most[rows][:, :, None])
    lists, at = np.divmod(at, apart.shape[1] * apart.shape[2])
    i, j = np.divmod(at, apart.shape[2])
    x, y = rows[lists, i], others[lists, j]
    return x[x < y], y[x < y]


def _lists(cols: list[np.ndarray], seconds: np.ndarray, upto: np.ndarray, cross: bool, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of all lists of ``cols``, postings of complete keys; ``seconds`` and their offsets ``upto`` as of ``prefix_rows``."""
    side = cols[2] & 1
    order = np.lexsort((side, cols[1], cols[0]))
    cols, side = [c[order] for c in cols], side[order]
    # a copy of a text repeats its postings: of each key, id and side one is kept
    new = np.ones(len(order), bool)
    new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (side[1:] != side[:-1])
    cols, order = [c[new] for c in cols], order[new]
    # entries: each posting under its key, or under its key and each second
    many = (upto[1:] - upto[:-1])[order]
    owner = np.repeat(np.arange(len(order)), np.maximum(1, many))
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(np.maximum(1, many)) - np.maximum(1, many), np.maximum(1, many))
    second = np.zeros(len(owner), np.int64)
    has = many[owner] > 0
    second[has] = seconds[(upto[:-1][order][owner] + nth)[has]].view(np.uint32)
    group = np.cumsum(np.concatenate([[0], cols[0][1:] != cols[0][:-1]]))[owner]
    key = (group << 32) | second
    by = np.argsort(key, kind="stable")
    key, owner = key[by], owner[by]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(at, len(key)))
    n = cols[2] >> _N
    # alike texts have at most 2 (n - T) + 1 words apart, n and T of either text, if half of the words or more must be common
    most = np.minimum(255, 2 * (n - (n * percent + 99) // 100) + 1 if percent >= 50 else 255 + 0 * n).astype(np.uint8)
    sigs = [s.view(np.uint64) for s in cols[3:]]
    for m in np.unique(size[size > 1]):
        own = at[size == m]
        if m * m <= BLOCK_PAIRS:
            step = int(BLOCK_PAIRS // (m * m))
            for k in range(0, len(own), step):
                rows = owner[own[k : k + step, None] + np.arange(m)]
                yield _fitting(*_near(rows, rows, sigs, most), cols, cross, percent)
            continue
        for lo in own:
            some = max(1, int(BLOCK_PAIRS // m))
            for row in range(lo, lo + m, some):
                yield _fitting(*_near(owner[None, row : min(row + some, lo + m)], owner[None, row : lo + m], sigs, most), cols, cross, percent)


def _merge(cross: bool, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Postings sorted by key -> (a, b)."""

    def once(found: list[np.ndarray]) -> pa.RecordBatch:
        both = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    def pairs(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        if not len(rows):
            return
        lists = rows.column("seconds").chunk(0)
        upto = np.asarray(lists.offsets).astype(np.int64)
        found: list[np.ndarray] = []
        many = 0
        for a, b in _lists([rows.column(k).to_numpy() for k in range(rows.num_columns - 1)], np.asarray(lists.values), upto, cross, percent):
            if len(a):
                found.append(np.stack([a, b], 1))
                many += len(a)
                if many >= FOUND_PAIRS:
                    yield once(found)
                    found, many = [], 0
        if found:
            yield once(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.asarray(batch.column(0))
            upto = int(np.searchsorted(key, key[-1], side="left"))
            if count >= MERGED_ROWS and (upto or held[-1].column(0)[-1].as_py() != key[0]):
                held.append(batch.slice(0, upto))
                yield from pairs(held)
                held, count, batch = [], 0, batch.slice(upto)
            held.append(batch)
            count += batch.num_rows
        if held:
            yield from pairs(held)

    return run


def _bloom_positions(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix(ids.astype(np.int64).view(np.uint64))
    return (h >> np.uint64(6)) % np.uint64(BLOOM_BITS), mix(h) % np.uint64(BLOOM_BITS)


def bloom_of(ids: DataFrame) -> np.ndarray:
    """A bit set of BLOOM_BITS bits of the column ``id``: built on the executors, at most 8 MB large."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(BLOOM_BITS // 8, np.uint8)
        some = False
        for batch in batches:
            if batch.num_rows:
                some = True
                for pos in _bloom_positions(np.asarray(batch.column(0))):
                    np.bitwise_or.at(own, (pos >> np.uint64(3)).astype(np.int64), np.left_shift(1, (pos & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        if some:
            words = own.view(np.int64)
            at = np.flatnonzero(words)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], names=["at", "bits"])

    rows = ids.mapInArrow(bits, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    own = np.zeros(BLOOM_BITS // 64, np.int64)
    own[np.asarray(rows["at"])] = np.asarray(rows["bits"])
    return own.view(np.uint8)


def passes(bloom: np.ndarray, ids: np.ndarray) -> np.ndarray:
    ok = np.ones(len(ids), bool)
    for pos in _bloom_positions(ids):
        ok &= (bloom[(pos >> np.uint64(3)).astype(np.int64)] >> (pos & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return ok


def _texts(bloom) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """row, side, text -> row, side, id, n and, for candidates, their numbered words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, codes, offsets = coded_words(batch.column(2))
            bags, n = bag_ids(table[codes], offsets), np.diff(offsets)
            pick = passes(bloom.value, bags)
            o = np.concatenate([[0], np.cumsum(np.where(pick, n, 0))])
            c, nth = numbered_codes(codes[np.repeat(pick, n)], len(table), o)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(bags), pa.array(n.astype(np.int32)), list_column(number(table[c], nth), o, pa.int64())],
                names=["row", "side", "id", "n", "words"],
            )

    return run


def alike(texts: DataFrame, percent: int, cross: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of ``texts`` (row long, side byte, text string) whose likeness is at least ``percent`` / 100.

    pairs (a, b, n_a, n_b, common) are of different classes, with ``cross`` of side 0 and side 1; members (row,
    side, id, n) maps every row to its class, the rows of one multiset of words.  Texts without a word have no pairs.
    """
    spark = texts.sparkSession
    ensure_importable(spark)
    counts = spark.sparkContext.broadcast(_counts(texts))
    postings = texts.select("side", "text").mapInArrow(_postings(counts, FREQUENT, percent), POSTING)
    candidates = cut(postings.repartition("key").sortWithinPartitions("key").mapInArrow(_merge(cross, percent), "a long, b long").distinct())
    bloom = spark.sparkContext.broadcast(bloom_of(candidates.select(F.explode(F.array("a", "b")).alias("id"))))
    rows = cut(texts.select("row", "side", "text").mapInArrow(_texts(bloom), "row long, side byte, id long, n int, words array<long>"))
    members = rows.where("n > 0").select("row", "side", "id", "n").distinct()
    classes = rows.where("size(words) > 0").groupBy("id").agg(F.first("n").alias("n"), F.first("words").alias("words"))
    left = classes.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("words").alias("words_a"))
    right = classes.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("words").alias("words_b"))
    pairs = (
        candidates.join(left, "a")
        .join(right, "b")
        .withColumn("common", F.size(F.array_intersect("words_a", "words_b")))
        .where(F.col("common") * 100 >= F.greatest("n_a", "n_b") * percent)
        .select("a", "b", "n_a", "n_b", "common")
    )
    return pairs, members
