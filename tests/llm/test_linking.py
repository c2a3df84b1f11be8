"""Near-duplicates and overlaps against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from quern.functions.words import bag_ids, coded_words, hashed_words, numbered_words
from quern.llm import prefixes
from quern.llm.neardup import near_duplicate_groups, near_duplicate_pairs
from quern.llm.overlap import cross_split_overlap, overlap_pairs, overlap_report


def brute(rows, percent=85):
    bags = [(i, Counter((t or "").lower().split())) for i, t in rows]
    out = set()
    for x, (i, a) in enumerate(bags):
        n = sum(a.values())
        for j, b in bags[:x]:
            m = sum(b.values())
            if i != j and n and m and min(n, m) * 100 >= max(n, m) * percent and sum((a & b).values()) * 100 >= max(n, m) * percent:
                out.add((min(i, j), max(i, j)))
    return out


def texts(seed=1, cluster=150, copies=60):
    """A cluster of slightly edited texts, exact copies, texts with a common beginning, short texts, edited ones."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(2000)]
    pick = lambda n: [rng.choice(words) for _ in range(n)]
    out = []
    base, copy, start = pick(120), pick(100), pick(60)
    for _ in range(cluster):
        t = list(base)
        for k in rng.sample(range(120), 4):
            t[k] = rng.choice(words)
        out.append(t)
    out += [copy] * copies + [copy[:3] + ["changed"] + copy[4:]]
    out += [start + pick(60) for _ in range(150)]
    out += [pick(rng.choice([1, 3, 7, 12, 30, 38, 42, 90])) for _ in range(200)]
    for _ in range(40):
        t = list(rng.choice(out))
        if len(t) > 7:
            t[rng.randrange(len(t))] = "edited"
            k = rng.randrange(len(t))
            out.append(t[k:] + t[:k])
    return [(i, " ".join(t)) for i, t in enumerate(out)]


def test_pairs_match_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([*rows, *rows[:50], (None, "x y"), (99991, None), (99992, ""), (99993, "!!!")], "record_id long, text string").repartition(5)
    df = df.withColumns({"id": F.lit("clash"), "row": F.lit(1), "side": F.lit(9), "words": F.lit(0)})
    got = {tuple(r) for r in near_duplicate_pairs(df, "record_id", "text").collect()}
    assert got == brute(rows)


def test_pairs_do_not_depend_on_the_order_of_rows(spark):
    rows = texts(2, 20, 5)
    a = spark.createDataFrame(rows, "record_id long, text string").repartition(1)
    b = spark.createDataFrame(rows[::-1], "record_id long, text string").repartition(7)
    assert {tuple(r) for r in near_duplicate_pairs(a, "record_id", "text").collect()} == {tuple(r) for r in near_duplicate_pairs(b, "record_id", "text").collect()}


def test_groups_keep_copies_as_one_class(spark):
    rows = texts(3, 30, 40)
    df = spark.createDataFrame(rows, "record_id long, text string")
    got = {r.record_id: r for r in near_duplicate_groups(df, "record_id", "text").collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in brute(rows):
        parent[max(find(a), find(b))] = min(find(a), find(b))
    members = {x: find(x) for x in list(parent)}
    assert {k: r.group_id for k, r in got.items()} == members
    assert got[30].class_rows == 40 and got[30].links >= 1


def family(rng, words, versions, size, edits):
    """Versions of one text, each with so many of its words replaced."""
    base = [rng.choice(words) for _ in range(size)]
    out = []
    for _ in range(versions):
        t = list(base)
        for k in rng.sample(range(size), edits):
            t[k] = rng.choice(words)
        out.append(t)
    return out


def test_families_at_the_threshold_are_whole(spark):
    """Versions of one text that differ from one another in 15 of 100 words."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(2000)]
    rows = [(i, " ".join(t)) for i, t in enumerate(family(rng, words, 250, 120, 9) + family(rng, words, 100, 93, 7))]
    df = spark.createDataFrame(rows, "record_id long, text string").repartition(3)
    want = brute(rows)
    assert len(want) > 5000
    assert {tuple(r) for r in near_duplicate_pairs(df, "record_id", "text").collect()} == want


def test_the_order_of_words_is_of_no_account(spark):
    rng = random.Random(12)
    t = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.sample(t, 60) + [f"own{i}"] * 5)) for i in range(30)]
    df = spark.createDataFrame(rows, "record_id long, text string")
    assert {tuple(r) for r in near_duplicate_pairs(df, "record_id", "text").collect()} == brute(rows)


def test_overlaps_of_a_large_family_are_whole(spark):
    rng = random.Random(13)
    words = [f"w{i}" for i in range(2000)]
    rows = [(i, " ".join(t)) for i, t in enumerate(family(rng, words, 250, 120, 10))]
    df = spark.createDataFrame([(i, "train" if i % 2 else "test", t) for i, t in rows], "record_id long, split string, output string").repartition(3)
    want = {p for p in brute(rows) if sum(p) % 2}
    assert len(want) > 1000
    assert {tuple(r) for r in overlap_pairs(df).collect()} == want


def test_evenly_spread_edits_in_short_texts(spark):
    """Pairs of 41 to 60 words with one word in seven replaced, as many as the likeness allows."""
    rng = random.Random(14)
    out = []
    for i in range(150):
        size = 41 + i % 20
        t = [f"w{rng.randrange(3000)}" for _ in range(size)]
        edits = set(range(i % 4, size, 7)[: size * 15 // 100])
        out += [t, [f"new{i}x{k}" if k in edits else w for k, w in enumerate(t)]]
    rows = [(i, " ".join(t)) for i, t in enumerate(out)]
    want = brute(rows)
    assert len(want) == 150
    df = spark.createDataFrame(rows, "record_id long, text string")
    assert {tuple(r) for r in near_duplicate_pairs(df, "record_id", "text").collect()} == want
    halves = spark.createDataFrame([(i, "test" if i % 2 else "train", t) for i, t in rows], "record_id long, split string, output string")
    assert {tuple(r) for r in overlap_pairs(halves).collect()} == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "record_id long, text string")
    assert near_duplicate_pairs(df, "record_id", "text").count() == 0
    assert near_duplicate_groups(df, "record_id", "text").count() == 0


def test_cross_split_overlap(spark):
    rows = texts(4, 40, 20)
    rng = random.Random(5)
    names = ["train", " TRAIN ", "training", "val", "Dev", "test", "holdout", None, "", "other"]
    split = {i: rng.choice(names) for i, _ in rows}
    side = lambda s: None if s is None or s.strip().lower() in ("", "other") else "train" if s.strip().lower() in ("train", "training") else "eval"
    df = spark.createDataFrame([(i, split[i], t, "ctx", "clash") for i, t in rows] + [(rows[0][0], split[rows[0][0]], rows[0][1], "ctx", "clash")], "record_id long, split string, output string, base_context_id string, id string")
    want = {p for p in brute(rows) if {side(split[p[0]]), side(split[p[1]])} == {"train", "eval"}}
    assert {tuple(r) for r in overlap_pairs(df).collect()} == want
    found = cross_split_overlap(df).collect()
    assert all(0.85 <= r.likeness <= 1 and 0 <= r.overlap <= 1 for r in found)
    assert sum(r.pairs for r in overlap_report(df).collect()) == len(want)
    assert overlap_pairs(df.limit(0)).count() == 0


def test_every_text_is_counted(spark, monkeypatch):
    rows = texts(6, 10, 10)
    want = np.bincount(prefixes._bucket(numbered_words(*hashed_words(pa.array([t for _, t in rows])))), minlength=1 << prefixes.BUCKET_BITS)
    monkeypatch.setattr(prefixes, "SAMPLE", 50, raising=False)
    got = prefixes._counts(spark.createDataFrame(rows, "row long, text string").repartition(3))
    assert (got == want).all()


def test_frequent_words_meet_under_one_key_each(spark, monkeypatch):
    """With words of over 5 texts posted with their seconds, over several keys from 20 texts on, and small blocks, no pair is lost."""
    monkeypatch.setattr(prefixes, "FREQUENT", 5)
    monkeypatch.setattr(prefixes, "KEY_ROWS", 20)
    monkeypatch.setattr(prefixes, "BLOCK_PAIRS", 64)
    monkeypatch.setattr(prefixes, "MERGED_ROWS", 100)
    rows = texts(7, 60, 30)
    want = brute(rows)
    tab = pa.RecordBatch.from_arrays([pa.array([0] * len(rows), pa.int8()), pa.array([t for _, t in rows])], names=["side", "text"])

    class Counts:
        value = prefixes._counts(spark.createDataFrame(rows, "row long, text string"))

    posted = pa.Table.from_batches(prefixes._postings(Counts, 5, 85)(iter([tab]))).sort_by("key")
    # one row for each word of the prefix and key, whatever the number of its seconds
    sizes = [len(t.split()) for _, t in rows]
    assert len(set(posted["key"].to_pylist())) > 100 and max(map(len, posted["seconds"].to_pylist())) > 5
    found = pa.Table.from_batches(prefixes._merge(False, 85)(iter(posted.to_batches(37))))
    ids = dict(zip(range(len(rows)), bag_ids(*hashed_words(tab.column(1))).tolist()))
    pairs = {tuple(sorted((ids[a], ids[b]))) for a, b in want if ids[a] != ids[b]}
    assert pairs <= set(zip(found["a"].to_pylist(), found["b"].to_pylist()))
    whole = pa.Table.from_batches(prefixes._postings(Counts, 1 << 30, 85)(iter([tab])))
    assert len(whole) <= sum(n - (n * 85 + 99) // 100 + 1 for n in sizes) and not any(whole["seconds"].to_pylist())


def test_words_of_all_letters_are_told_apart():
    rows = ["Ab_c  d9", None, "", "!?", "Straße, Ünï—x", "日本 語x١٢", "tail", "a b'c", "head"]
    want = [[w for w in re.split(r"[^\w]|_", (t or "").lower()) if w] for t in rows]
    table, codes, offsets = coded_words(pa.array(rows))
    assert np.diff(offsets).tolist() == [len(w) for w in want]
    assert table[codes].tolist() == [xxhash.xxh64_intdigest(w.encode()) for t in want for w in t]
    assert np.diff(hashed_words(pa.array([None, ""]))[1]).tolist() == [0, 0]
