import random

from quern.llm.leakage import cleaned_corpus, leaked_items, standing_sentences

STANDING = "Read the following case with care and answer it plainly. "


def made(seed=1):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "brick cloud dune elm flint gorse heath iron jetty kiln".split() for b in "able bank cote dale edge ford gate hill isle jamb".split()]
    items = [(i, (STANDING if i % 2 else "") + " ".join(rng.choice(words) for _ in range(60)) + ".") for i in range(30)]
    noise = lambda n: " ".join(rng.choice(words) for _ in range(n))
    core = {i: t.removeprefix(STANDING).rstrip(".").split() for i, t in items}
    docs, want = [(0, None), (1, ""), (2, " \n"), (3, STANDING * 5), (4, noise(4000))], set()

    def add(text, *hits):
        docs.append((len(docs), text))
        want.update((len(docs) - 1, h) for h in hits)

    for i in range(0, 30, 3):
        c = core[i]
        add(noise(40) + " " + " ".join(c) + " " + noise(30), i)
        add(" ".join(c).upper().replace(" ", ",\n"), i)
        add("".join(x + "́" if x in "aeo" else x for x in " ".join(c)), i)
        edited = list(c)
        for k in range(6, 60, 11):
            edited[k] = "changed"
        add(noise(10) + " " + " ".join(edited), i)
        add(noise(20) + " " + " ".join(c[:22]) + " " + noise(25) + " " + " ".join(c[35:55]), i)
        add(" ".join(c[:20]) + " " + noise(50))  # a third only
        shuffled = list(c)
        rng.shuffle(shuffled)
        add(" ".join(shuffled))
        add(" ".join(w[: len(w) // 2] + "-\n" + w[len(w) // 2 :] if k % 5 == 0 else w for k, w in enumerate(c)), i)
    return docs, items, want


def test_leaks(spark):
    docs, items, want = made()
    d = spark.createDataFrame([(*x, 1) for x in docs + docs[5:8]], "doc_id long, text string, item_id int").repartition(4)
    b = spark.createDataFrame(items + items[:2] + [(100, None), (101, ""), (None, "x")], "item_id long, text string")
    assert standing_sentences(b) == [STANDING.strip()]
    got = {(r.doc_id, r.item_id) for r in leaked_items(d, b).collect()}
    assert got == want
    joined = leaked_items(d, b, most_broadcast=1)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, leaked_items(d, b).collect()))
    kept = {r.doc_id for r in cleaned_corpus(d, b).collect()}
    assert kept == {i for i, _ in docs} - {x for x, _ in want}


def test_nothing_to_find(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert leaked_items(d, none).count() == 0 and leaked_items(d.limit(0), d.selectExpr("doc_id item_id", "text")).count() == 0
    assert leaked_items(d, none, most_broadcast=0).count() == 0


def test_items_that_share_most_of_their_words(spark):
    """Grams that every item has are no anchors, yet every item is found."""
    common = " ".join(f"same{i}" for i in range(40))
    items = [(i, f"{common} " + " ".join(f"own{i}x{k}" for k in range(30))) for i in range(60)]
    docs = [(i, f"before {t} after") for i, t in items] + [(1000, common)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(i, j) for i, _ in docs for j, _ in items}  # the common part is more than half of an item
    for most in (10**6, 1):
        assert {(r.doc_id, r.item_id) for r in leaked_items(d, b, most_broadcast=most).collect()} == want
