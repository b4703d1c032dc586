import numpy as np
from pyspark.sql import functions as F

from scriptorium.operators import groups, profiles


def blobs(spread=0.1):
    rng = np.random.default_rng(1)
    return np.concatenate([rng.normal(0, spread, (20, 10)) + 3 * np.eye(10)[k] for k in range(3)])


def agreement(a, b):
    pairs = [(x == y) == (u == v) for i, (x, u) in enumerate(zip(a, b)) for y, v in list(zip(a, b))[:i]]
    return sum(pairs) / len(pairs)


def test_blobs(spark):
    x = blobs()
    truth = np.repeat(range(3), 20)
    assert agreement(groups.density_labels(x), truth) == 1
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(99, None)], "id int, v array<double>")
    km = {r.id: r.cluster for r in groups.kmeans(df, "id", "v", 3).collect()}
    assert agreement([km[i] for i in range(60)], truth) == 1 and 99 not in km
    assert 3 <= groups.best_k(df, "v") <= 7
    dens = {r.id: r.cluster for r in groups.density(df, "id", "v").collect()}
    assert agreement([dens[i] for i in range(60)], truth) == 1
    few = groups.density(df, "id", "v", sample=30).toPandas()
    assert len(few) == 60
    labelled = df.where("v is not null").withColumn("c", (F.col("id") / 20).cast("int"))
    assert groups.silhouette(labelled, "v", "c") > 0.5
    top = groups.central(labelled, "c", "id", "v").collect()
    assert len(top) == 9
    assert groups.density(df.limit(0), "id", "v").collect() == [] and groups.central(labelled.limit(0), "c", "id", "v").collect() == []


def test_density_edges():
    assert (groups.density_labels(np.zeros((3, 2))) == -1).all()
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 0.05, (15, 2)), rng.normal(4, 0.05, (15, 2)), [[100.0, 100.0]]])
    labels = groups.density_labels(x)
    assert labels[-1] == -1 and len(set(labels[:30])) == 2


def test_density_is_fitted_on_all_rows(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.uniform(0, 100, (3000, 6)), *(rng.normal(0, 0.01, (7, 6)) + 100 + 20 * k for k in range(30))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, v array<double>")
    got = {r.id: r.cluster for r in groups.density(df, "id", "v").collect()}
    want = groups.density_labels(x)
    assert len(got) == len(x)
    for k in range(30):  # each small group is found whole and alone
        ids = range(3000 + 7 * k, 3007 + 7 * k)
        assert len({got[i] for i in ids}) == 1 and got[ids[0]] >= 0 and sum(c == got[ids[0]] for c in got.values()) == 7
    names = {(int(want[i]), got[i]) for i in got}
    assert len(names) == len({a for a, _ in names}) == len({b for _, b in names})  # the same groups as of all rows at once


def runs(spark):
    schema = "run_id bigint, clusters array<struct<id int, size int, is_noise boolean, sample_ids array<string>, centroid_emails array<string>>>"
    ids = lambda p, n: [f"{p}{i}" for i in range(n)]
    return spark.createDataFrame([(1, [(0, 6, False, ids("a", 6), None), (1, 9, None, ids("b", 9), None), (2, 1, False, None, None), (-1, 20, True, ids("n", 20), None)]), (2, None)], schema)


def test_runs(spark):
    done = spark.createDataFrame([("a0",), ("a1",), ("a1",), (None,), ("n3",)], "email_id string")
    left = groups.remaining(runs(spark), done, "email_id").groupBy("cluster").count().collect()
    assert {(r.cluster, r["count"]) for r in left} == {(0, 4), (1, 9)}
    cov = {r.cluster: (r.analysed, r.required, r.complete) for r in groups.coverage(runs(spark), done, "email_id").collect()}
    assert cov == {0: (2, 5, False), 1: (0, 8, False)}
    h = groups.health(runs(spark)).collect()
    assert [(x.groups, x.noise, x.total, x.warnings) for x in h] == [(3, 20, 35, "high_noise")]
    assert {(r.chunk, r.n) for r in groups.chunks(runs(spark), 4).collect()} == {("0_0", 4), ("0_1", 2), ("1_0", 4), ("1_1", 4), ("1_2", 1)}
    assert [(r.cluster, r.left) for r in groups.next_group(runs(spark), done, "email_id").collect()] == [(1, 9)]


PERSONA = "persona_id string, persona_name string, description string, characteristics struct<formality:int,warmth:int,authority:int,directness:int,typical_greeting:string,typical_closing:string,uses_contractions:boolean>"


def test_profiles(spark):
    p = spark.createDataFrame([("a", "A", "plain updates", (6, 8, 7, 5, None, None, None)), ("b", "B", "", (8, 4, 9, 7, "Hi", "Best", False)), ("c", "C", "x", None), ("d", "D", "x", (5, 5, 5, 5, None, None, None)), ("e", "E", "x", (None, 11, 1, 1, None, None, None))], PERSONA)
    merged = {r.persona_id: (r.formality, r.warmth, r.authority, r.directness) for r in profiles.merge(p.where("persona_id in ('a', 'b')"), {"b": "a"}).collect()}
    assert merged == {"a": (7, 6, 8, 6)}
    checks = {r.persona_id: r for r in profiles.schema_checks(p).collect()}
    assert checks["a"].valid and checks["d"].valid and checks["d"].warnings == "all scores equal"
    assert checks["b"].errors == "no description" and checks["c"].errors == "no characteristics" and checks["e"].errors == "no formality; warmth out of range"
    pairs = spark.createDataFrame([("1", "about updates", None, None, [], None, None, True), ("2", None, None, None, None, None, None, None)], "id string, subject string, quoted string, sender string, tone_hints array<string>, greeting string, closing string, has_contractions boolean")
    inferred = profiles.infer(pairs, p.where("persona_id in ('a', 'd')"))
    assert {(r.id, r.inferred_persona, r.confidence) for r in inferred.collect()} == {("1", "a", 0.2), ("2", "a", 0.3)}
    scored = {r.id: r.composite for r in profiles.score(inferred, p).collect()}
    assert scored == {"1": 0.76, "2": 0.66}


def test_registry(spark):
    old = spark.createDataFrame([("a", "old", 1, 1)], "name string, description string, created int, updated int")
    new = spark.createDataFrame([("a", "new", 2), ("b", "first", 2), ("b", "later", 3)], "name string, description string, updated int")
    samples = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", None)], "id string, persona string")
    once = profiles.upsert(old, new, samples)
    want = {("a", "new", 1, 2, 1), ("b", "later", 3, 3, 0)}
    assert {tuple(r) for r in once.collect()} == want
    assert {tuple(r) for r in profiles.upsert(once, new, samples).collect()} == want
    votes = spark.createDataFrame([("x", True)] * 3 + [("y", False), ("y", None)], "persona string, good boolean")
    assert {(r.persona, r.status) for r in profiles.feedback(votes).collect()} == {("x", "well_calibrated"), ("y", "needs_refinement")}
    s = spark.createDataFrame([("1", " Email", "AB"), ("2", "email", "ab"), ("3", "post", None), ("4", "post", "cd")], "id string, source string, content_hash string")
    fresh = profiles.new_samples(s, s.where("id = '4'"))
    assert [tuple(r) for r in fresh.collect()] == [("email", "ab", 1)]
