"""Boundaries of op6_packing at lengths of more than 512 words."""

import itertools
import random

from quarrykit.llm import packing


def test_long_lengths_are_cells_of_their_own(spark):
    rng = random.Random(4)
    lengths = [rng.randint(1000, 1030) for _ in range(60)]
    table = spark.createDataFrame([(x,) for x in lengths], "length long")
    got = packing.boundaries(packing.histogram(table), 4)
    pad = lambda ends: sum(min(e for e in ends if e >= x) - x for x in lengths)
    distinct = sorted(set(lengths))
    assert len(got) <= 4 and pad(got) == min(pad([*c, distinct[-1]]) for c in itertools.combinations(distinct[:-1], 3))
