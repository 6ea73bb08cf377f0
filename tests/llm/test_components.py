import random

import pytest
from pyspark.sql import functions as F

from rankloom.llm.common import components, numbered
from rankloom.llm.shared_keys import shared_keys


def test_components(spark):
    rng = random.Random(0)
    for edges in ([], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(rng.randrange(200), rng.randrange(200)) for _ in range(150)], [(None, 1), (3, 2)]):
        parent = {}

        def find(x, parent=parent):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in edges:
            if a is not None and a != b:
                a, b = find(a), find(b)
                parent[max(a, b)] = min(a, b)
        got = components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in list(parent))


def test_numbered(spark):
    rows = spark.range(100).selectExpr("id % 3 as k", "id % 7 as cell", "id")
    got = numbered(rows, ["k"], "cell", ["id"], F.lit(1), "n").collect()
    for k in range(3):
        mine = sorted((r["n"], r["cell"], r["id"]) for r in got if r["k"] == k)
        assert [n for n, _, _ in mine] == list(range(len(mine))) and [x[1:] for x in mine] == sorted(x[1:] for x in mine)


def test_shared_keys(spark):
    import numpy as np

    from rankloom.llm.hashing import mix

    def keys_of(texts):
        return mix(np.array([int(t) for t in texts.to_pylist()], np.uint64))

    values = [i for i in range(500) for _ in range(1 + (i % 5 == 0) * (i // 10))]
    frame = spark.createDataFrame([(str(v),) for v in values], "text string").repartition(3)
    table = shared_keys(frame, keys_of, len(values), 1000)
    once = {i for i in range(500) if values.count(i) == 1}
    flags = table.repeated(mix(np.arange(500, dtype=np.uint64)))
    assert all(flags[i] for i in range(500) if i not in once)
    assert sum(flags[i] for i in once) <= 5
    levels = table.levels(mix(np.arange(500, dtype=np.uint64)))
    assert levels[495] == 5 and pytest.approx(levels[1]) == 0
