import numpy as np

from quern.llm import licenses, ordinal, queries

SF = "/root/testdata/sf0.01"


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    grades = ordinal.graded(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    model = ordinal.train(docs, grades.where("doc_id % 4 <> 0"))
    held = grades.where("doc_id % 4 = 0")
    rows = ordinal.scored(docs.join(held, "doc_id"), model).join(held, "doc_id").collect()
    # a third of the labels "toxic" are on texts without any sign of it, so these can't be told
    share = lambda g: np.mean([r.kept for r in rows if r.grade == g])
    assert share(0) < 0.01 and share(1) < 0.45 and share(2) > 0.985, (share(0), share(1), share(2))
    means = [np.mean([r.expected_grade for r in rows if r.grade == g]) for g in range(3)]
    assert means[0] < means[1] < means[2]
    assert all(0 <= r.tail_2 <= r.tail_1 <= 1 for r in rows)
    assert np.all(np.diff(model.thresholds) > 0)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (None, "good words", 1.0), (1, None, 1.0)], "doc_id long, text string, kept double")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 1, 1), (9, 0, 0)], "doc_id long, quality int, toxic int")
    model = ordinal.train(docs, ordinal.graded(labels))
    assert ordinal.scored(docs, model).count() == 4
    model = ordinal.train(docs, ordinal.graded(labels.where("false")))
    assert ordinal.scored(docs.where("false"), model).count() == 0


def test_licenses_of_the_table(spark):
    lines = {"GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0."}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = sorted((d, k) for d, t in docs for k, v in lines.items() if v in t)
    assert sorted((r.doc_id, r.license) for r in queries.op1_license_scan(spark, SF).collect()) == want and want


def test_licenses_by_wording(spark):
    long = licenses.TEMPLATES["Apache-2.0"][1]
    noise = "some other words that say nothing of it " * 500
    rows = [
        (1, noise + long.replace("may not use", "shall not use") + noise, 0), (2, "Released under the XYZ License.", 0), (3, None, 0), (4, "", 0), (5, "license", 0),
        (6, "licensed under CC BY-SA 4.0\nand\nReleased under the\tMIT license", 0), (None, "LICENSED UNDER CC BY 4.0", 0), (7, long.replace(" ", "\n"), 0), (8, "license " * 20_000 + "Released under the MIT License.", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license int")
    got = {(r.doc_id, r.license): r.n_different for r in licenses.scan(docs).collect()}
    assert got.pop((1, "Apache-2.0")) <= 1
    assert got == {(6, "CC-BY-SA-4.0"): 0, (6, "MIT"): 0, (None, "CC-BY-4.0"): 0, (7, "Apache-2.0"): 0, (8, "MIT"): 0}
    assert licenses.scan(docs.where("false")).count() == 0


def test_several_licenses_in_changed_wording():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    found = lambda *texts: {x[0]: x[3] for x in scanner.scan(" Some words in between. ".join(texts))}
    line = lambda name, version="4.0", a="a": f"This work is licensed under {a} Creative Commons {name} {version} International License."
    by, sa, nc = "Attribution", "Attribution-ShareAlike", "Attribution-NonCommercial"
    assert found(line(by), line(sa, a="the")) == {"CC-BY-4.0": 0, "CC-BY-SA-4.0": 1}
    assert found(line(sa, a="the"), line(by)) == {"CC-BY-4.0": 0, "CC-BY-SA-4.0": 1}
    assert found(line(by), line(sa, a="the"), line(nc, a="the"), line(by, "3.0", "the")) == {"CC-BY-4.0": 0, "CC-BY-SA-4.0": 1, "CC-BY-NC-4.0": 1, "CC-BY-3.0": 1}
    # a license that is stated again leaves no place to those that are like it
    assert found(*[line(by)] * 5) == {"CC-BY-4.0": 0}
    assert found(line(by), line(by, a="the"), line(by)) == {"CC-BY-4.0": 0}


def test_long_templates_and_cues():
    rng = __import__("random").Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(800)]
    long = " ".join(rng.choice(words) for _ in range(3600))
    templates = {"Long-1.0": ("The license. " + long,), "Plain-1.0": (" ".join(words[:30]),), **licenses.TEMPLATES}
    scanner = licenses.Scanner(templates)
    changed = long.split()
    for i in range(0, 3600, 40):
        changed[i] = "other"
    noise = " ".join(f"n{i}" for i in range(5000))
    text = f"{noise}\n The license. {' '.join(changed)} {noise} {' '.join(words[:30])} {noise}"
    assert {x[0]: x[3] for x in scanner.scan(text)} == {"Long-1.0": 90, "Plain-1.0": 0}
    import re

    pattern = re.compile(licenses.cues(templates), re.IGNORECASE)
    for own in templates.values():
        for t in own:
            assert sum(bool(pattern.search(w)) for w in licenses.bare(t)) > int(licenses.DIFFERENT * len(licenses.bare(t)))


def edits(template, block):
    """Least word edits that turn a stretch of the block into the template, by the plain table."""
    row = [0] * (len(block) + 1)
    for w in template:
        above, row = row, [row[0] + 1]
        for j, x in enumerate(block):
            row.append(min(above[j] + (x != w), above[j + 1] + 1, row[j] + 1))
    return min(row)


def test_alignment_and_scan_against_a_plain_version(spark):
    import random

    rng = random.Random(2)
    for _ in range(60):
        template, block = ([rng.choice("abcde") for _ in range(rng.randint(1, n))] for n in (9, 25))
        n, start, end = licenses.aligned(template, block)
        assert n == edits(template, block) == edits(template, block[start:end])
    lines = [t for own in licenses.TEMPLATES.values() for t in own]
    rows = []
    for i in range(40):
        w = rng.choice(lines).split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "changed"
        rows.append((i // 2, "some words before it " * 20 + " ".join(w) + " and after it" * 20))
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")
    best = lambda t: min((edits(licenses.bare(x), licenses.bare(t)) / len(licenses.bare(x)), -len(licenses.bare(x)), k) for k, own in licenses.TEMPLATES.items() for x in own)
    want = sorted((d, b[2], round(b[0] * -b[1])) for d, t in [*rows, rows[0]] if (b := best(t))[0] <= licenses.DIFFERENT)
    got = sorted((r.doc_id, r.license, r.n_different) for r in licenses.scan(docs).collect())
    assert got == want


def test_the_sample_bounds_what_is_fitted(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"w{i}") for i in range(500)] + [(2, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(ordinal, "fit", lambda rows, *a: seen.append(len(rows)))
    ordinal.train(docs, ordinal.graded(labels), sample=20)
    assert seen == [20]


def test_likelihood_by_finite_differences():
    """The fit ends near the least of the plain likelihood: no small step of a weight or threshold lowers it much."""
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(600):
        g = int(rng.integers(0, 3))
        at = [k for k in range(6) if rng.random() < (0.2 + 0.25 * g if k < 3 else 0.5)]
        rows.append((at, [1.0] * len(at), g))
    model = ordinal.fit(rows, dimensions=6, epochs=60, rate=0.02, decay=0.0, least=0.0)

    def loss(w, theta):
        out = 0.0
        for at, value, g in rows:
            s = sum(w[k] * v for k, v in zip(at, value))
            f = [0.0, *(1 / (1 + np.exp(-(t - s))) for t in theta), 1.0]
            out -= np.log(f[g + 1] - f[g])
        return out / len(rows)

    here = loss(model.weights, model.thresholds)
    for k in range(8):
        for step in (-0.05, 0.05):
            w, theta = model.weights.astype(float).copy(), model.thresholds.copy()
            (w if k < 6 else theta)[k if k < 6 else k - 6] += step
            assert loss(w, theta) > here - 2e-3
    even = [-float(np.log(np.mean([r[2] == g for r in rows]))) for g in range(3)]
    assert here < np.mean([even[r[2]] for r in rows]) - 0.05


def test_long_texts_and_missing_grades(spark):
    docs = spark.createDataFrame([(1, "word " * 500_000), (2, "x" * 2_000_000), (3, "fine words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = ordinal.scored(docs, ordinal.train(docs, ordinal.graded(labels))).collect()
    assert len(got) == 3 and all(0 <= r.expected_grade <= 2 for r in got)
