"""Mixing against the loop that the closed form replaces."""

import random

import pytest

from lexispark.llm import mixing


def water_fill_loop(sizes, weights, cap):
    """Clamp what is above its cap, reshare the rest by weight, until nothing is."""
    left, open_, target = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / w >= cap * sizes[i]}
        if not over:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = float(cap * sizes[i])
            left -= target[i]
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    r = random.Random(seed)
    names = sorted({f"s{r.randrange(99)}" for _ in range(r.randint(1, 9))} | {"É", "z"})
    sizes = [r.choice((0, 1, 10, 500, 100_000)) + r.randrange(50) for _ in names]
    df = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")
    got = {x["source"]: x["target"] for x in mixing.water_fill(mixing.cycled_weights(df, (1.0, 2.0, 3.0)), 3.0).collect()}
    want = water_fill_loop(sizes, [(1, 2, 3)[i % 3] for i in range(len(names))], 3)
    assert [got[n] for n in names] == pytest.approx(want)


def test_mix(spark):
    r = random.Random(9)
    rows = [(i, "w " * r.randint(0, 60), r.choice(["a", "a", "a", "a", "b", "c", None])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    for s in {x["source"] for x in got}:
        own = [x for x in got if x["source"] == s]
        assert {x["source_size"] for x in own} == {sum(x["size"] for x in own)}
        assert abs(sum(x["taken"] for x in own) - own[0]["target"]) <= 1
        assert sum(0 < x["taken"] - x["repeats"] * x["size"] < x["size"] for x in own) <= 1
    assert all(0 <= x["taken"] <= 3 * x["size"] for x in got)
    again = {x["doc_id"]: x["taken"] for x in mixing.mix(df.repartition(7)).collect()}
    assert again == {x["doc_id"]: x["taken"] for x in got}


def test_odd(spark, odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and {x["size"] for x in got if x["doc_id"] in (0, 1, 2)} == {0}
    assert mixing.mix(none).count() == 0
    assert mixing.mix(odd.where("text is null")).first()["taken"] == 0


def test_no_python_in_the_plan(spark, small):
    plan = mixing.op5_mixing(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
