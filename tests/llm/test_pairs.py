"""A term that is neutral by itself and toxic beside another one."""

import random

import numpy as np

from quarrykit.llm import toxicity


def test_neutral_term_beside_a_slur():
    rng = random.Random(1)
    kinds = [("slurword", 0)] * 100 + [("slurword zebra", 1)] * 100 + [("zebra", 0)] * 200 + [("otherslur", 1)] * 100 + [("", 0)] * 100
    rng.shuffle(kinds)
    texts = [(" ".join(rng.choices("abc def ghi jkl mno pqr".split(), k=8)) + " " + k).encode() for k, _ in kinds]
    labels = np.array([y for _, y in kinds], np.float64)
    zebra = labels[[b"zebra" in t for t in texts]]
    assert zebra.mean() == labels.mean()  # neutral
    machine = toxicity.fit(toxicity.term_slots(texts), labels)
    score = machine.score(toxicity.term_slots([b"abc slurword", b"abc slurword zebra", b"abc zebra"]))
    assert score[0] < 0.5 < score[1] and score[2] < 0.5
