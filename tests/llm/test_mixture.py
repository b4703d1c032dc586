import pytest

from scriptorium.llm import mixture

SIZES = "id long, source string, size long"
TARGETS = "mix_id int, source string, target_share double, max_repeats int, corpus_share double"


def frames(spark):
    rows = [(i, "a", 10 + i % 7) for i in range(4000)] + [(10_000 + i, "b", 20) for i in range(300)] + [(20_000, "c", 5), (20_001, None, 100), (20_002, "a", 0)]
    targets = [(1, " A ", 0.5, 3, 0.5), (1, "b", 0.3, 3, 0.5), (1, "c", 0.2, 3, 0.5), (2, "B", 1.0, 10, 1.0), (2, "none", 0.0, 1, 1.0)]
    return spark.createDataFrame(rows, SIZES), spark.createDataFrame(targets, TARGETS)


def test_shares_and_caps(spark):
    sizes, targets = frames(spark)
    total = sizes.agg({"size": "sum"}).first()[0]
    mixed = mixture.mixtures(sizes, targets)
    got = {(r.mix_id, r.source): r for r in mixture.shares(mixed, targets).collect()}
    assert abs(got[1, "a"].actual_size - 0.25 * total) < 0.01 * total
    assert abs(got[1, "b"].actual_size - 0.15 * total) < 0.01 * total
    assert got[1, "c"].actual_size == 15 and got[1, "c"].most_repeats == 3
    assert got[2, "b"].actual_size == pytest.approx(total, rel=0.02) and got[2, "b"].most_repeats <= 10
    assert got[2, "none"].actual_size == 0
    assert {tuple(r) for r in mixture.mixtures(sizes, targets).collect()} == {tuple(r) for r in mixed.collect()}
    copies = mixed.groupBy("mix_id", "id").agg({"copy_no": "max", "*": "count"}).where("`max(copy_no)` <> `count(1)`")
    assert copies.count() == 0
    places = [r.place for r in mixed.where("mix_id = 1").collect()]
    assert places == sorted(places)


def test_none(spark):
    sizes, targets = frames(spark)
    assert mixture.mixtures(sizes.limit(0), targets).collect() == [] and mixture.mixtures(sizes, targets.limit(0)).collect() == []
    with pytest.raises(ValueError):
        mixture.mixtures(sizes, targets.unionByName(targets))


def test_poisson():
    assert mixture.thresholds(0.0, 2) == [1.0, 1.0]
    a, b = mixture.thresholds(1.0, 2)
    assert (round(a, 4), round(b, 4)) == (0.3679, 0.7358)
    assert mixture.solve([1.0] * 10, 30.0, 3) == float("inf") and mixture.solve([0.0] * 10, 3.0, 3) == 0
    rate = mixture.solve([1.0] * 1000, 500.0, 50)
    assert abs(rate - 0.5) < 1e-3
