"""Targets and draws of the mix against plain Python."""

import random
from fractions import Fraction

import pytest

from spindrift.llm import mixing

SHAPE = "doc_id long, text string, source string, key string, size string, n_docs long"


def water(sizes, weights, share, most):
    """Shares by weight; who is above the bound stops there, and the rest is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, at = Fraction(share) * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in at]
        level = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if level[s] > most * sizes[s]]
        if not over:
            return {**at, **level}
        for s in over:
            at[s] = most * Fraction(sizes[s])
            left -= at[s]


@pytest.mark.parametrize("seed", range(3))
def test_targets(spark, seed):
    dice = random.Random(seed)
    sizes = {None: 40, "": 7, **{f"s{i}": dice.choice([0, 1, 50, 5000, 100_000]) for i in range(30)}}
    want = water(sizes, [3, 1, 2], 1.5, 2)
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), [3, 1, 2], 1.5, 2.0).collect()
    assert {r.source: r.target for r in rows} == {s: pytest.approx(float(t)) for s, t in want.items()}


def test_draws(spark):
    dice = random.Random(4)
    rows = [(i, " ".join(["w"] * int(1 / (dice.random() + 0.005))), "hot" if i % 3 else dice.choice([None, "a", "b"]), "k", "z", 3) for i in range(3000)]
    rows += [(5000 + i, "one and the same text", "hot", "k", "z", 3) for i in range(500)] + [(9000, "x  y\tz\n", "solo", "k", "z", 3)]
    docs = spark.createDataFrame(rows, SHAPE)
    got = mixing.mix(docs.repartition(7), [3, 1, 2]).collect()
    again = mixing.mix(docs.repartition(3, "text"), [3, 1, 2]).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    assert {r.doc_id: r.size for r in got} == {r[0]: len(r[1].split()) for r in rows}
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len(r[1].split())
    want = water(sizes, [3, 1, 2], 1.5, 2)
    for source, target in want.items():
        own = [r for r in got if r.source == source]
        assert all(r.source_size == sizes[source] and r.target == pytest.approx(float(target)) for r in own)
        rate = float(target) / sizes[source]
        assert {r.copies for r in own} <= {int(rate), -int(-rate // 1)}
        assert abs(sum(r.taken for r in own) - target) <= 2 * max(r.size for r in own)
        assert abs(sum(r.copies for r in own) - rate * len(own)) <= 1
    drawn = mixing.drawn(docs, [3, 1, 2])
    assert drawn.columns == docs.columns
    assert sum(len(r.text.split()) for r in drawn.collect()) == sum(r.taken for r in got)


def test_odd_rows(spark):
    rows = [(1, None, "a", "k", "z", 1), (None, "x y", "a", "k", "z", 1), (None, "x y", "a", "k", "z", 1), (3, "", None, "k", "z", 1), (3, "p q r", None, "k", "z", 1), (4, "w " * 200_000, "big", "k", "z", 1)]
    docs = spark.createDataFrame(rows, SHAPE)
    got = mixing.mix(docs, [3, 1, 2]).collect()
    assert sorted(r.size for r in got) == [0, 0, 2, 2, 3, 200_000] and all(r.taken <= 2 * r.size for r in got)
    assert mixing.mix(docs.where("false"), [3, 1, 2]).count() == 0
    blank = mixing.mix(docs.withColumn("text", mixing.F.lit(None).cast("string")), [3, 1, 2]).collect()
    assert len(blank) == 6 and {(r.target, r.taken) for r in blank} == {(0.0, 0)}
