import random
from collections import Counter
from hashlib import sha256

import pytest

from quern.llm import debruijn, hashing, queries, simhash, substrings
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def made(seed=1):
    """Texts that share passages, repeat their own, hold runs of one letter, and are empty, blank or null."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7)))
    para = [" ".join(word() for _ in range(60)) for _ in range(6)]
    out = []
    for i in range(40):
        parts = [rng.choice([rng.choice(para), " ".join(word() for _ in range(rng.randint(1, 80))), rng.choice(para)[rng.randint(0, 100) :], "a" * rng.randint(1, 500), "x y " * rng.randint(1, 90)]) for _ in range(rng.randint(0, 4))]
        out.append((i, rng.choice(["\n", " ", ""]).join(parts)))
    return [*out, (100, ""), (101, " \n "), (102, None), (103, out[0][1]), (104, "q" * 1000)]


def frame(spark, docs, partitions=3):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(partitions)


def tuples(df):
    return sorted(tuple(r) for r in df.collect())


def test_byte_repeats(spark):
    docs = made()
    got = tuples(substrings.digest(substrings.repeats(frame(spark, docs))))
    assert got == sorted(brute.byte_repeats([(d, (t or "").encode()) for d, t in docs]))


def test_op7_on_the_whole_table(spark):
    docs = [(d, (t or "").encode()) for d, t in texts(spark)]
    windows = Counter(hash(t[i : i + 200]) for _, t in docs for i in range(len(t) - 199))
    want = []
    for d, t in docs:
        kept, spans, end = [], 0, -1  # end of the bytes that are gone so far
        for i in range(len(t) - 199):
            if windows[hash(t[i : i + 200])] > 1:
                if i > end:
                    kept.append(t[max(end, 0) : i])
                    spans += 1
                end = i + 200
        rest = b"".join([*kept, t[max(end, 0) :]])
        want.append((d, len(t), len(t) - len(rest), spans, sha256(rest).hexdigest()))
    assert tuples(queries.op7_suffix_dedup(spark, SF)) == sorted(want) and len(want) == 200 and sum(x[2] for x in want) > 0


@pytest.mark.parametrize("width, slices", [(200, 1), (30, 3), (90, 2)])
def test_byte_repeats_at_other_widths(spark, monkeypatch, width, slices):
    docs = made(2)
    got = tuples(substrings.digest(substrings.repeats(frame(spark, docs), width=width, gram=min(40, width // 2), slices=slices), width=width))
    assert got == sorted(brute.byte_repeats([(d, (t or "").encode()) for d, t in docs], width))


def test_steps():
    assert substrings.steps(200) == [(0, 64), (64, 64), (72, 128)]
    assert substrings.steps(30) == [(0, 30)] and substrings.steps(128) == [(0, 64), (64, 64)] and substrings.steps(129) == [(0, 64), (64, 64), (1, 128)]


def test_runs_across_chunks(monkeypatch):
    docs = made(2)
    monkeypatch.setattr(hashing, "CHUNK", 97)
    values, ends = substrings.flat(__import__("pyarrow").array([(t or "").encode() for _, t in docs], "binary"))
    small = sum(int(n.sum()) for _, n, *_ in hashing.minimizer_runs(values, ends, 200, 40, substrings.BYTES))
    assert small == sum(max(0, len((t or "").encode()) - 199) for _, t in docs)


def test_rows_that_repeat_entirely(spark):
    text = " ".join(f"w{i}" for i in range(150))
    rows = [(1, text), (1, text), (2, "w" * 199), (2, "w" * 199), (None, None), (None, "")]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in substrings.digest(substrings.repeats(frame(spark, rows))).collect()), key=str)
    assert got == sorted([(1, len(text), len(text), 1)] * 2 + [(2, 199, 0, 0)] * 2 + [(None, 0, 0, 0)] * 2, key=str)


@pytest.mark.parametrize("module, count", [(debruijn, 60), (substrings, 500)])
def test_ids_of_other_types(spark, module, count):
    text = " ".join(f"w{i:07d}" for i in range(60))
    rows = [("b", text), ("a", text + " and"), (None, "x"), (None, text)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {(r.doc_id, r[1]): r.n_removed for r in module.digest(module.repeats(df)).collect()}
    if module is debruijn:
        assert got == {("b", 60): 60, ("a", 61): 60, (None, 1): 0, (None, 60): 0}
    else:
        assert got == {("b", 539): 539, ("a", 543): 539, (None, 1): 0, (None, 539): 539}


def test_texts_of_megabytes(spark):
    rng = random.Random(9)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]) + str(rng.randrange(40)) for _ in range(300_000))
    part = long[1_000_000:1_002_000]
    df = frame(spark, [(1, long), (2, "before " + part + " after")])
    got = {r.doc_id: r.n_removed for r in substrings.digest(substrings.repeats(df)).collect()}
    assert got == {1: len(part) + got[1] - len(part), 2: got[2]} and min(got.values()) >= len(part) and max(got.values()) <= len(part) + 8
    got = {r.doc_id: r.n_removed for r in debruijn.digest(debruijn.repeats(df)).collect()}
    assert got[1] == 0 and got[2] >= len(part.split()) - 2


def test_paths_are_compacted(spark):
    text = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    rows = debruijn.keyed(frame(spark, [(1, text(0, 400)), (2, text(0, 400)), (3, "y " + text(100, 160) + " z"), (4, "q " + text(130, 300))]), "doc_id", "text")
    runs = debruijn.super_kmers(rows, 20, 8)
    graph = debruijn.edges(debruijn.opened(rows, runs.select("doc", "start", "n", debruijn.F.lit(False).alias("copies"), debruijn.F.lit(False).alias("whole")), 20))
    paths = debruijn.compacted(graph, block=16).collect()
    # only repeated edges are in the graph, and they have one way on each: the whole text is one path
    assert sorted((r.doc.id, r.root, r.off) for r in paths) == [(1, 0, i) for i in range(381)]
    one, two = text(0, 100) + " a b " + text(200, 260), text(0, 100) + " c d " + text(200, 260)
    rows = debruijn.keyed(frame(spark, [(1, one), (2, two), (3, one), (4, two)]), "doc_id", "text")
    runs = debruijn.super_kmers(rows, 20, 8)
    graph = debruijn.edges(debruijn.opened(rows, runs.select("doc", "start", "n", debruijn.F.lit(False).alias("copies"), debruijn.F.lit(False).alias("whole")), 20))
    assert {(r.doc.id, r.root) for r in debruijn.compacted(graph, block=16).collect()} == {(1, 0), (1, 81), (2, 81), (1, 102)}


def test_word_repeats(spark):
    docs = made(3)
    assert tuples(debruijn.digest(debruijn.repeats(frame(spark, docs)))) == sorted(brute.word_repeats(docs))


def test_word_repeats_of_the_table(spark):
    assert tuples(queries.op10_substring_dedup(spark, SF)) == sorted(brute.word_repeats(texts(spark)))


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, 0, "x"), (1, text, 0, "x"), (None, text, 0, "y"), (2, text + " z", 1, None), (2, "other", 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, gram string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in debruijn.digest(debruijn.repeats(df)).collect()), key=str)
    assert got == sorted([(1, 60, 60), (1, 60, 60), (None, 60, 0), (2, 61, 60), (2, 1, 0)], key=str)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in substrings.digest(substrings.repeats(df)).collect()), key=str)
    n = len(text)
    assert got == sorted([(1, n, n), (1, n, n), (None, n, n), (2, n + 2, n), (2, 5, 0)], key=str)


@pytest.mark.parametrize("module", [debruijn, substrings])
def test_empty_table(spark, module):
    assert module.digest(module.repeats(frame(spark, []))).count() == 0


def test_simhash_of_the_table(spark):
    docs = texts(spark)
    prints = [(d, brute.fingerprint(t)) for d, t in docs]
    least = brute.linked(prints)
    assert tuples(queries.op8_simhash(spark, SF)) == sorted((d, f"{f:016x}", least[d]) for d, f in prints)


@pytest.mark.parametrize("pairs_up_to", [1, 4, 1000])
def test_links(spark, pairs_up_to):
    rng, fps = random.Random(5), []
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(25):
            f ^= sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 3)))
            fps.append(f & (1 << 64) - 1)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, pairs_up_to)).collect()}
    want = brute.linked([(s, f) for s, f in zip(signed, fps)])
    assert {s: roots.get(s, s) for s in signed} == want


def test_representatives(spark):
    rows = [(3, "a b c", 1), (1, "A B C", 2), (1, "A B C", 2), (None, "a b c", 3), (7, None, 4), (8, " ", 5), (9, "something else entirely", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    assert sorted((r.doc_id, r.fp) for r in simhash.representatives(df).collect()) == [(1, 2), (7, 4), (9, 6)]
    assert simhash.representatives(df.where("false")).count() == 0


def test_simhash_of_odd_rows(spark):
    rows = [("b", "a b c"), ("a", "A B C"), (None, "a b c"), (None, "quite other words"), ("c", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {(r.id, r.component) for r in simhash.near_duplicates(df).collect()}
    assert got == {("a", "a"), ("b", "a"), (None, "a"), (None, None), ("c", "c")}
    assert simhash.near_duplicates(df.where("false")).count() == 0
    assert sorted(str(r.doc_id) for r in simhash.representatives(df).collect()) == ["None", "a", "c"]
