import random

from tracefold.functions import order


def test_running_and_numbered(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([float(k), k / 7, -k * 1.5]), rng.randint(0, 5)) for k in range(700)]
    rows = list({r[1]: r for r in rows}.values())
    df = spark.createDataFrame(rows, "id int, x double, n int").repartition(5)
    got = {r.id: r.before_n for r in order.running(df, "x", ["n"]).collect()}
    total = 0
    for i, _, n in sorted(rows, key=lambda r: r[1]):
        assert got[i] == total
        total += n
    numbers = {r.id: r.i for r in order.numbered(df, "id").collect()}
    assert sorted(numbers.values()) == list(range(len(rows)))
    assert numbers == {r.id: r.i for r in order.numbered(df.repartition(2), "id").collect()}
    assert order.running(df.limit(0), "x", ["n"]).count() == 0 and order.numbered(df.limit(0), "id").count() == 0
