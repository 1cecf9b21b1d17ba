"""Random histories, hot ids included, against plain Python."""

import random

import pytest

from entitylake.operators import upsert as U
from entitylake.sources.history import ARRIVED, History

SCHEMA = "id long, a string, b string, seq long"


def history(seed, length, first=0):
    """Changes of which a third concern id 0."""
    rng = random.Random(seed)
    rows = []
    for seq in range(first, first + length):
        key = 0 if rng.random() < 0.34 else rng.randrange(12)
        rows.append((key, rng.choice([None, f"a{seq}"]), rng.choice([None, f"b{seq}"]), seq))
    rng.shuffle(rows)
    return rows


def table_of(df):
    return {r.id: (r.a, r.b, r.seq) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_upsert_and_merge(spark, seed):
    base = {i: (f"a-{i}", None, -1) for i in range(0, 20, 2)}
    changes = history(seed, 60)
    upserted, merged = dict(base), dict(base)
    for key, a, b, seq in sorted(changes, key=lambda r: r[3]):
        upserted[key] = (a, b, seq)
        old = merged.get(key, (None, None, None))
        merged[key] = (a or old[0], b or old[1], seq)
    stored = spark.createDataFrame([(k, *v) for k, v in base.items()], SCHEMA)
    incoming = spark.createDataFrame(changes, SCHEMA).repartition(5)
    assert table_of(U.upsert(stored, incoming, order_by=("seq",))) == upserted
    assert table_of(U.merge_fields(stored, incoming, order_by=("seq",))) == merged


@pytest.mark.parametrize("newest", [False, True])
def test_table_over_many_batches(spark, tmp_path, newest):
    table = History(spark, str(tmp_path / "t"), order_by=["seq"] if newest else [ARRIVED, "seq"])
    rng = random.Random(7)
    expected = {}
    firsts = [40, 0, 120, 80, 160, 20]  # late batches among them
    for number, first in enumerate(firsts):
        batch = history(first, 25, first)
        table.append(spark.createDataFrame(batch, SCHEMA).repartition(3))
        for key, a, b, seq in sorted(batch, key=lambda r: r[3]):
            if not newest or key not in expected or seq >= expected[key][2]:
                expected[key] = (a, b, seq)
        if number % 2:
            gone = rng.sample(range(12), 3)
            table.delete(spark.createDataFrame([(g,) for g in gone], "id long"))
            for key in gone:
                expected.pop(key, None)
        assert table_of(table.current()) == expected
