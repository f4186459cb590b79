from collections import Counter

import corpus_pipeline
from quern.llm import common, contamination, mixing, rules, sharding
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_a_plain_version(spark):
    table = common.table(spark, SF, "documents")
    docs, left = table, {r.doc_id: r for r in table.collect()}
    bench = [(r.item_id, r.text) for r in common.table(spark, SF, "benchmark").collect()]
    kept = {r.doc_id for r in rules.apply_policy(rules.ledger(table)).where("kept").collect()}
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, SF))
        out.append(docs)
    assert all(x.columns == table.columns for x in out[:-1])
    assert {r.doc_id for r in out[0].collect()} == kept
    least = brute.linked([(d, brute.fingerprint(left[d].text)) for d in kept])
    assert sorted(r.doc_id for r in out[1].collect()) == sorted(set(least.values()))

    def shingles(t):
        w = contamination.bare_words((t or "").encode())
        return {tuple(w[i : i + 5]) for i in range(max(0, len(w) - 4))}

    items = [s for _, t in bench if (s := shingles(t))]
    clean = {d for d in set(least.values()) if not any(len(s & shingles(left[d].text)) >= 0.8 * len(s) for s in items)}
    assert {r.doc_id for r in out[2].collect()} == clean and len(clean) < len(set(least.values()))
    copies = Counter(r.doc_id for r in out[3].collect())
    assert set(copies) <= clean and max(copies.values()) <= 3
    plan = {r.doc_id: r for r in mixing.plan(out[2]).collect()}
    for d, r in plan.items():
        assert abs(copies[d] * r.size - r.taken) <= r.size
    final = out[4].collect()
    assert Counter(r.doc_id for r in final) == copies
    assert set(table.columns) < set(out[4].columns)


def test_empty_table(spark):
    docs = common.table(spark, SF, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_shards(spark):
    rows = [(i, None if i == 3 else "x" * i, "t") for i in range(500)] + [(None, "null", "t"), (7, "again", "t"), (7, "again", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    leaves = sharding.tree(8)
    got = sharding.assign(docs, leaves, more=sharding.grown(leaves), buckets=16).collect()
    assert len(got) == len(rows)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, 8) for r in got) and any(r.grown_shard == 8 for r in got)
    # heavier leaves draw only into their own subtree
    heavy = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in leaves]
    moved = {(r.shard, s.shard) for r, s in zip(sorted(got, key=str), sorted(sharding.assign(docs, leaves, more=heavy, buckets=16).collect(), key=str)) for s in [s] if r.shard != s.grown_shard}
    assert moved
    for r in sharding.assign(docs, leaves, more=heavy).collect():
        assert r.grown_shard == r.shard or r.grown_shard in (4, 5, 6, 7)


def test_mix_reaches_targets(spark):
    rows = [(i, " ".join(["w"] * (i % 37)), None if i % 11 == 0 else "ab"[i % 7 == 0]) for i in range(800)]
    docs = spark.createDataFrame([*rows, (900, None, "empty")], "doc_id long, text string, source string")
    got = mixing.plan(docs, buckets=8).collect()
    size = Counter()
    for i, t, s in rows:
        size[s] += i % 37
    sizes = {"a": size["a"], "b": size["b"], "empty": 0, None: size[None]}
    total, goal, weight = sum(sizes.values()), {}, dict(zip(["a", "b", "empty", None], [1, 2, 3, 1]))
    free, rest = set(sizes), float(total)
    while True:
        w = sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / w > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            goal[s] = 3.0 * sizes[s]
            free.discard(s)
        rest = total - sum(goal.values())
    goal |= {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
    source = {i: s for i, _, s in rows} | {900: "empty"}
    taken = Counter()
    for r in got:
        assert abs(r.target - goal[source[r.doc_id]]) < 1e-6 and 0 <= r.taken <= 3 * r.size and r.source_size == sizes[source[r.doc_id]]
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 1 for s in sizes)


def integral(schedule, t, steps=4000):
    """By the midpoint rule, scaled to 1 at t = 1."""
    n = len(schedule) - 1
    rate = lambda x: schedule[min(n - 1, int(x * n))] + (schedule[min(n - 1, int(x * n)) + 1] - schedule[min(n - 1, int(x * n))]) * (x * n - min(n - 1, int(x * n)))
    part = lambda end: sum(rate(end * (i + 0.5) / steps) for i in range(steps)) * end / steps
    return part(t) / part(1.0)


def test_taken_positions_and_order_against_a_plain_version(spark):
    from pyspark.sql import functions as F

    schedules = ((0.4, 1.6), (1.0, 2.0, 0.5, 0.0), (1.6, 0.4))
    rows = [(i if i % 9 else None, " ".join(["w"] * (1 + i % 13) + [f"x{i}"]), "abc"[i % 3]) for i in range(60)] + [(500, None, "a"), (501, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.plan(docs, schedules=schedules, buckets=4).collect()
    assert sorted(map(str, mixing.plan(docs, schedules=schedules, buckets=4).collect())) == sorted(map(str, got))
    hashed = docs.select("doc_id", "text", "source", F.xxhash64("doc_id", "text", F.lit("mix")).alias("h")).collect()
    bucket = lambda h: h % 4
    goal = {r.source_size: r.target for r in got}
    names = {"a": 0, "b": 1, "c": 2, None: 0}
    size = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in names}
    demand = [sum(goal[size[s]] for s in names if names[s] == k) for k in range(3)]
    want = []
    for s in names:
        place = 0
        for r in sorted((r for r in hashed if r.source == s), key=lambda r: (bucket(r.h), r.h)):
            n = len((r.text or "").split())
            taken = [max(0, min(n, round(goal[size[s]]) - j * size[s] - place)) for j in range(3)]
            position = None
            if taken[0]:
                share, low, high = min(1.0, (place + taken[0] / 2) / max(1.0, goal[size[s]])), 0.0, 1.0
                for _ in range(30):
                    mid = (low + high) / 2
                    low, high = (mid, high) if integral(schedules[names[s]], mid, 200) < share else (low, mid)
                position = sum(d * integral(x, low, 200) for d, x in zip(demand, schedules))
            want.append((r.doc_id, n, sum(taken), position))
            place += n
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    plain = sorted(want, key=key)
    for r, w in zip(sorted(((r.doc_id, r.size, r.taken, r.first_position) for r in got), key=key), plain, strict=True):
        assert r[:2] == w[:2]
    by_size = lambda rows: sorted((n, t, p or 0.0) for _, n, t, p in rows)
    for a, b in zip(by_size((r.doc_id, r.size, r.taken, r.first_position) for r in got), by_size(want), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-2 * max(1.0, b[2])
    order = [r.first_position for r in got if r.first_position is not None]
    assert order == sorted(order)


def test_slots_follow_the_written_order(spark):
    from pyspark.sql import functions as F

    docs = common.written(mixing.curriculum(common.table(spark, SF, "documents"), position=None).repartitionByRange(5, F.monotonically_increasing_id()))
    seen = docs.select("doc_id", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i")).collect()
    got = corpus_pipeline.sharding_to_tree(spark, docs, SF).select("doc_id", "shard", "slot").collect()
    home = {r.doc_id: r.shard for r in got}
    for s in range(8):
        want = [r.doc_id for r in sorted(seen, key=lambda r: (r.f, r.i)) if home[r.doc_id] == s]
        own = sorted((r.slot, r.doc_id) for r in got if r.shard == s)
        assert [x[0] for x in own] == list(range(len(want))) and [x[1] for x in own] == want


def test_shards_against_a_plain_version(spark):
    from math import log

    from pyspark.sql import functions as F

    leaves = [sharding.Leaf(x.region, x.rack, x.shard, 1.0 + x.shard) for x in sharding.tree(8)]
    docs = common.table(spark, SF, "documents")
    names = sorted({n for x in leaves for n in (x.region, f"{x.region}/{x.rack}", f"{x.region}/{x.rack}/{x.shard}")})
    draws = {r.doc_id: r for r in docs.select("doc_id", *(F.xxhash64("doc_id", F.lit(n)).alias(n) for n in names)).collect()}
    for r in sharding.assign(docs, leaves).collect():
        def draw(name, own):
            u = ((draws[r.doc_id][name] % (1 << 64) >> 11) + 0.5) / (1 << 53)  # noqa: B023
            return -log(u) / sum(x.weight for x in own)

        own = leaves
        for name in (lambda x: x.region, lambda x: f"{x.region}/{x.rack}", lambda x: f"{x.region}/{x.rack}/{x.shard}"):
            best = min({name(x) for x in own}, key=lambda n: draw(n, [x for x in own if name(x) == n]))  # noqa: B023
            own = [x for x in own if name(x) == best]
        assert [x.shard for x in own] == [r.shard]


def test_ablation(spark):
    docs = common.table(spark, SF, "documents")
    rows = rules.ledger(docs)
    bits = [r.fail_bits for r in rows.collect()]
    for r in rules.ablation(rows, [rules.BASE, rules.CURRENT]).collect():
        p = rules.BASE if r.policy == "base" else rules.CURRENT
        bit = 1 << list(rules.RULES).index(r.rule)
        kept = sum(not b & p.mask for b in bits)
        assert (r.n_docs, r.n_fail, r.n_kept) == (len(bits), sum(bool(b & bit) for b in bits), kept)
        assert r.n_kept_only_without == sum(not b & p.mask & ~bit for b in bits) - kept


def test_rules_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "a b a b a b", 3), (4, "\x0bq\x0c\r\nq\n\nq", 4)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in rules.ledger(docs).collect()}
    assert [got[d].n_words for d in (1, 2, None, 4)] == [0, 0, 6, 3]
    assert got[None].n_repeat_words == brute.repeat_words("a b a b a b") == 6
    assert got[4].n_dup_lines == 1 and got[4].word_chars == 3
    assert rules.ablation(rules.ledger(docs.where("false"))).count() == 0


def test_clashing_columns_nulls_and_repeated_rows(spark):
    names = ["size", "Shard", "slot", "target", "source_size", "weight", "slope", "mix_position", "n_words", "kept", "fp", "component", "gram", "w", "h", "id"]
    word = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    rows = [(i, word(i, 60 + i), "a" if i % 2 else None) for i in range(12)] + [(3, word(3, 63), "a"), (None, word(50, 80), "b"), (77, None, "b"), (78, "", None)]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.columns
        docs = common.written(stage(spark, docs, SF))
        assert k == 4 or docs.columns == before
        if k == 0:
            assert docs.count() == 14
        if k == 1:
            assert docs.count() == 13
    assert {"input_size", "input_Shard", "input_slot", "size", "shard", "slot"} <= set(docs.columns) and docs.count()
