import random

from pyspark.sql import functions as F

from scriptorium.operators import groups, json_text, profiles, registry, render
from scriptorium.streaming import live


def test_best_profile_alike_in_tiles(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(i, rng.randint(0, 9)) for i in range(50)], "id int, x int")
    p = spark.createDataFrame([(f"p{k:02d}", rng.randint(0, 9)) for k in range(30)], "persona_id string, y int")
    fit = lambda q: -F.abs(F.col("x") - q["y"])
    one = sorted(tuple(r) for r in profiles.with_best(rows, "id", p, fit).select("id", "best.score", "best.persona_id").collect())
    many = sorted(tuple(r) for r in profiles.with_best(rows, "id", p, fit, 7).select("id", "best.score", "best.persona_id").collect())
    known = sorted((r.persona_id, r.y) for r in p.collect())
    want = sorted((r.id, -min(abs(r.x - y) for _, y in known), min((abs(r.x - y), k) for k, y in known)[1]) for r in rows.collect())
    assert one == many == want
    assert profiles.with_best(rows, "id", p.limit(0), fit).where("best.persona_id is not null").count() == 0


def test_numbers_within_a_hot_group(spark):
    rows = [("hot", f"{i:04d}") for i in range(300)] + [("b", "x"), (None, "n1"), (None, "n2")]
    got = profiles.numbered_within(spark.createDataFrame(rows, "g string, k string"), "g", "k", "n").collect()
    assert {(r.g, r.k, r.n) for r in got} == {("hot", f"{i:04d}", i + 1) for i in range(300)} | {("b", "x", 1), (None, "n1", 1), (None, "n2", 2)}


def test_leaders_equal_the_plain_walk(spark):
    rng = random.Random(5)
    rows = [(f"s{i:03d}", rng.sample(["formal", "warm", "concise"], rng.randint(0, 3)), rng.choice(["", "formal", "casual"]), rng.choice(["", "Hi {name},", "Hey,", "Dear {name},"])) for i in range(80)]
    rows += [("s900", None, None, None), ("s901", [], "", "")]
    left, want = sorted(rows, key=lambda r: r[0]), {}
    form = lambda r: {"tone": set(r[1] or []), "formality": r[2] or "", "greeting": r[3] or ""}
    while left:
        lead, *rest = left
        mine = [lead] + [r for r in rest if profiles.likeness(form(lead), form(r)) >= 0.5]
        want |= {r[0]: (lead[0], len(mine), len(mine) >= 3) for r in mine}
        left = [r for r in rest if r not in mine]
    df = spark.createDataFrame(rows, "id string, tone array<string>, formality string, greeting string")
    assert {r.id: (r.leader, r.size, r.kept) for r in profiles.leaders(df).collect()} == want
    assert profiles.leaders(df.limit(0)).collect() == []


def test_weights_of_likeness(spark):
    a = {"tone": ["warm"], "formality": "formal", "greeting": "Hi", "closing": "Best", "contractions": "rare", "sentence": "short", "hook": "question"}
    for key, weight in (("tone", 0.25), ("greeting", 0.15), ("closing", 0.15), ("hook", 0.15), ("sentence", 0.1), ("contractions", 0.1)):
        b = dict(a)
        b[key] = ["formal"] if key == "tone" else "other"
        cols = lambda d: {k: F.array(*map(F.lit, v)) if k == "tone" else F.lit(v) for k, v in d.items()}
        assert abs(spark.range(1).select(profiles.match(cols(a), cols(b))).first()[0] - (1 - weight / 1.1)) < 1e-5


def test_drafts_and_state(spark, tmp_path):
    path = str(tmp_path / "draft")
    assert registry.load_draft(spark, path) is None and not registry.drop_draft(spark, path)
    draft = spark.createDataFrame([(1, 0, ["a", "b"], "p"), (1, 1, ["b"], "o"), (1, 2, [], "o"), (2, 0, ["c"], None)], "run_id long, cluster int, sample_ids array<string>, persona string")
    registry.save_draft(draft, path)
    approved = {tuple(r) for r in registry.approved(registry.batches(registry.load_draft(spark, path))).collect()}
    assert approved == {("a", "p"), ("b", "o")}
    assert registry.drop_draft(spark, path) and not registry.has_draft(spark, path)
    counts = {"one": spark.range(3), "two": spark.range(0), "three": spark.range(0)}
    assert [tuple(r) for r in registry.state(counts, ["one", "two", "three"]).orderBy("step").collect()] == [("one", 3, True, False), ("three", 0, False, False), ("two", 0, False, True)]


def test_batches_hold_all(spark):
    df = spark.createDataFrame([("g", f"{i:03d}", "t" * 2000 if i == 5 else "t") for i in range(70)] + [(None, "x", None)], "g string, id string, body string")
    got = render.batch_text(df, "g", "id", ["body"], 30).collect()
    assert sorted((r.g or "", r.batch, r.n) for r in got) == [("", 0, 1), ("g", 0, 30), ("g", 1, 30), ("g", 2, 10)]
    assert "t" * 2000 in next(r.text for r in got if r.g == "g" and r.batch == 0)


def test_upserts_write_touched_buckets_only(spark, tmp_path):
    schema = "k int, t int, v string"
    source, table, log = str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "log")
    for batch in ([(i, 1, "a") for i in range(40)], [(3, 2, "b")], [(3, 1, "late"), (99, 1, "c")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        live.upsert_batches(spark.readStream.schema(schema).parquet(source), table, "k", "t", log, 8).awaitTermination()
    got = {r.k: r.v for r in live.current(spark, table, schema).collect()}
    assert got == {**{i: "a" for i in range(40)}, 3: "b", 99: "c"}
    assert len(list((tmp_path / "table" / "v1").glob("_b=*"))) == 1


def test_alike_vectors_and_overview(spark):
    rng = random.Random(1)
    rows = [(f"v{i}", [rng.gauss(0, 1) for _ in range(4)]) for i in range(40)] + [("z", [0.0] * 4), ("n", None)]
    df = spark.createDataFrame(rows, "id string, v array<double>")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = {(a, b) for a, x in rows[:40] for b, y in rows[:40] if a < b and dot(x, y) >= 0.85 * (dot(x, x) * dot(y, y)) ** 0.5}
    assert {(r.id_a, r.id_b) for r in groups.alike_vectors(df, "id", "v").collect()} == want and want
    assert groups.alike_vectors(df.limit(0), "id", "v").collect() == []
    o = groups.overview(spark.createDataFrame([(-1,)] * 5 + [(0,)] * 2 + [(1,)] * 3, "cluster int")).orderBy("place").collect()
    assert [(r.cluster, r["size"]) for r in o] == [(1, 3), (0, 2), (-1, 5)]


def test_bank_and_examples(spark):
    s = spark.createDataFrame([("p", f"i{k}", c) for k, c in enumerate((0.9, 0.85, 0.84, 0.99, 0.9, 0.9, 0.9, None))], "g string, id string, confidence double")
    assert [r.id for r in json_text.example_bank(s, "g").orderBy("rank").collect()] == ["i3", "i0", "i4", "i5", "i6"]
    a = spark.createDataFrame([(1, 0.5, "x"), (2, 0.5, "y")], "k int, rate double, text string")
    m = spark.createDataFrame([(1, 0.7)], "k int, rate double")
    assert [tuple(r) for r in json_text.with_metrics(a, m, "k", ["rate"]).orderBy("k").collect()] == [(1, 0.7, "x"), (2, 0.5, "y")]
