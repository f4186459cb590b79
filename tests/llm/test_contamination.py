from quern.llm import contamination

ITEMS = [(1, "Alpha beta gamma delta epsilon zeta, eta theta iota kappa."), (2, "one two"), (3, ""), (4, None), (5, " ".join(f"t{i}" for i in range(300)))]


def found(docs, items, **more):
    return sorted((r[0], r[1], r.shared_shingles) for r in contamination.contained(docs, items, **more).collect())


def test_short_items_in_long_documents(spark):
    noise = " ".join(f"n{i}" for i in range(5000))
    docs = spark.createDataFrame([
        (1, noise + " ALPHA beta gamma delta epsilon zeta eta theta iota kappa " + noise, 0), (2, noise + " alpha beta gamma delta epsilon " + noise, 0), (3, "One, two!", 0),
        (4, None, 0), (5, "", 0), (6, " ".join(f"t{i}" for i in range(250)), 0), (7, " ".join(f"t{i}" for i in range(200)), 0), (None, "one two", 0),
    ], "doc_id long, text string, item_id int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = [(1, 1, 6), (3, 2, 1), (6, 5, 246), (None, 2, 1)]
    got = [(r[0], r[1], r.shared_shingles) for r in contamination.contained(docs, items).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    blocks = [(r[0], r[1], r.shared_shingles) for r in contamination.contained(docs, items, block_bytes=500).collect()]
    assert sorted(blocks, key=str) == sorted(want, key=str)
    assert sorted(r.doc_id for r in contamination.clean(docs, items, block_bytes=500).collect()) == [2, 4, 5, 7]


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    assert contamination.contained(docs.where("false"), items).count() == 0
    assert contamination.contained(docs, items.where("false")).count() == 0
    assert contamination.clean(docs, items.where("false")).count() == 1


def test_the_table_against_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))

    def shingles(t):
        w = contamination.bare_words((t or "").encode())
        return {tuple(w[i : i + 5]) for i in range(max(0, len(w) - 4))}

    own = {r.item_id: shingles(r.text) for r in items.collect()}
    want = sorted((r.doc_id, i) for r in docs.collect() for x in [shingles(r.text)] for i, s in own.items() if s and len(s & x) >= 0.8 * len(s))
    assert sorted((r.doc_id, r.item_id) for r in contamination.contained(docs, items).collect()) == want and want


def test_repeated_items_and_documents(spark):
    text = "one two three four five six"
    docs = spark.createDataFrame([(1, "a " + text), (1, "a " + text), (2, "no")], "doc_id long, text string")
    items = spark.createDataFrame([(7, text), (7, text), (8, text), (None, text)], "item_id long, text string")
    for more in ({}, {"block_bytes": 10}):
        got = sorted(((r.doc_id, r.item_id) for r in contamination.contained(docs, items, **more).collect()), key=str)
        assert got == sorted([(1, 7), (1, 7), (1, 8), (1, None)] * 2, key=str)
        assert [r.doc_id for r in contamination.clean(docs, items, **more).collect()] == [2]
