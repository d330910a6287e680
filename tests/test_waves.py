"""Blocks of a large corpus run in waves, so early ones are not run again with the late ones."""

from pyspark.sql import functions as F

from glosswork import stages
from glosswork.operators import online, vectors as vec
from glosswork.plans import catalog


def test_a_round_runs_the_blocks_of_its_wave_only(spark, monkeypatch):
    q = stages.write(catalog.conv_quotes(spark, "/root/testdata/sf0.001", one_corpus=True).limit(150))
    ran, real = [], online._choices

    def seen(rows, states, target):
        ran.append(tuple(rows.agg(F.min("block"), F.max("block")).first()))
        return real(rows, states, target)

    monkeypatch.setattr(online, "_choices", seen)
    online.choose(q, vec.weigh(q)[1], 3, 16)
    assert max(high for _, high in ran) > 7
    assert all(high < max(online.FIRST, 2 * low) for low, high in ran)
