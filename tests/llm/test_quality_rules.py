"""Rules that vote at every length."""

import random

import pytest

from spindrift.llm import quality_rules


@pytest.mark.parametrize("n", [5000, 5001, 20_000])
def test_variety_votes_at_every_length(spark, n):
    dice = random.Random(n)
    vocabulary = ["".join(dice.choices("aeinorst", k=6)) for _ in range(n)]
    junk, rich = dice.choices(vocabulary[:300], k=n), vocabulary
    docs = spark.createDataFrame([(1, " ".join(junk)), (2, " ".join(rich))], "doc_id long, text string")
    figures = quality_rules.figures(docs).withColumn("vote", quality_rules.votes()["variety"])
    assert {r.doc_id: r.vote for r in figures.select("doc_id", "vote").collect()} == {1: quality_rules.BAD, 2: quality_rules.GOOD}
