from pyspark.sql import functions as F

from quern import release
from quern.plans import policy

GOOD = {"record_id": 1, "db_id": "a", "q": "How many?", "c": "count em", "MQL": "db.t.aggregate([{$match: {a: 1}}])", "difficulty": "L4", "sql_infeasibility_class": "structural_schema_flex", "shape_policy": "reduce", "schema_flex": "polymorphic", "world_signature": "w"}


def _table(spark, *changes):
    rows = [{**GOOD, **x} for x in changes]
    kinds = "record_id long, db_id string, q string, c string, MQL string, difficulty string, sql_infeasibility_class string, shape_policy string, schema_flex string, world_signature string, banned array<string>"
    df = spark.createDataFrame([tuple({"banned": list(policy.FORBIDDEN), **r}[f.split()[0]] for f in kinds.split(", ")) for r in rows], kinds)
    return df.withColumn("nl_queries", F.struct(F.col("q").alias("canonical"), F.col("c").alias("colloquial"))).withColumn("canonical_form_set", F.struct(F.col("banned").alias("must_not_contain"))).drop("q", "c", "banned")


def test_contracts(spark):
    df = _table(
        spark, {}, {"record_id": 2, "q": " "}, {"record_id": 3, "c": "数"}, {"record_id": 4, "difficulty": "L9"}, {"record_id": 5, "MQL": "db.t.find()"}, {"record_id": 6, "MQL": "db.t.aggregate([{$out: 'x'}])"},
        {"record_id": 7, "schema_flex": "none"}, {"record_id": 8, "schema_flex": None, "sql_infeasibility_class": "feasible"}, {"record_id": 9, "MQL": None}, {"record_id": 10, "banned": ["$out"]},
    )
    found = sorted((r.record_id, r.problem) for r in release.contracts(df).collect())
    assert found == [
        (2, "question is blank"), (3, "question isn't English"), (4, "difficulty"), (4, "structural flex isn't hardest"), (5, "pipeline is unreadable"), (6, "pipeline is forbidden"),
        (7, "structural flex without flex"), (9, "no MQL"), (9, "pipeline is empty"), (10, "form allows forbidden operators"),
    ]
    assert {r.problem for r in release.contracts(df.select("record_id", "MQL")).collect()} >= {"no db_id", "shape"}


def test_composition_and_duplicates_of_nothing(spark):
    none = _table(spark, {}).where("false")
    assert release.composition(none).first().broken == "empty"
    assert not release.duplicates(none).collect() and not release.diversity(none).collect()
    assert release.composition(_table(spark, {}), databases=1).first().broken == ""


def test_duplicates_see_through_notation(spark):
    df = _table(spark, {}, {"record_id": 2, "MQL": "db.t.aggregate([ {'$match': {\"a\": 1.0}} ])", "q": " how  MANY? "}, {"record_id": 3, "MQL": "db.t.aggregate([{$match: {b: 2}}])", "q": "x"})
    assert sorted(tuple(r) for r in release.duplicates(df, family=2).collect()) == [("a", "pipeline", 1, 2), ("a", "question", 1, 2), ("a", "skeleton", 1, 3)]


def test_selection_against_plain(spark):
    rows = [(f"d{i % 3}", i, i * 7 % 11, i * 5 % 6) for i in range(60)]
    df = _table(spark, *({"db_id": d, "record_id": i, "MQL": f"db.t.aggregate([{{$limit: {p + 1}}}])", "q": f"q{q}"} for d, i, p, q in rows))
    want = set()
    for d in ("d0", "d1", "d2"):
        own, ps, qs = [], [], []
        for new in (True, False):
            for e, i, p, q in rows:
                if e == d and len(own) < 9 and p not in ps and not (new and q in qs):
                    own.append((d, i)), ps.append(p), qs.append(q)
        want |= set(own)
    assert {(r.db_id, r.record_id) for r in release.select_distinct(df, 9).collect()} == want


def test_slots_against_plain(spark):
    features = [(f"d{i % 2}", f"f{i}", release.STRUCTURES[(i * i) % 5]) for i in range(13)]
    got = [tuple(r) for r in release.plan_slots(spark.createDataFrame(features, "db_id string, feature_id string, structure string"), per_db=17, seed=3).orderBy("slot").collect()]
    assert [r[0] for r in got] == list(range(1, 35))
    for d in ("d0", "d1"):
        used, kinds, own = {f[1]: 0 for f in features if f[0] == d}, dict.fromkeys(release.STRUCTURES, 0), {f[1]: f[2] for f in features if f[0] == d}
        for _, _, feature, kind, use in (r for r in got if r[1] == d):
            best = min((used[f], kinds[k], release.STRUCTURES.index(k)) for f, k in own.items())
            assert (used[feature], kinds[kind], release.STRUCTURES.index(kind)) == best and use == used[feature] + 1
            used[feature] += 1
            kinds[kind] += 1


def test_sanitising(spark):
    df = spark.sql("select 1 as _id, named_struct('gold', 1, 'x', array(named_struct('gold', 2, 'y', 3))) as a, 5 as gold, map('gold', 1, 'k', 2) as m")
    assert release.without(df, {"gold"}).first().asDict(True) == {"_id": 1, "a": {"x": [{"y": 3}]}, "m": {"k": 2}}
    assert release.public(_table(spark, {})).first().asDict(True) == {"db_id": "a", "record_id": 1, "nl_queries": {"canonical": "How many?"}}
    assert release.shared_models(["M-1 ", "m-2"], {"judges": ["m-1"], "makers": ["m-3"]}) == {"judges": ["m-1"]}
