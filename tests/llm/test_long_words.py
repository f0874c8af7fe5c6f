"""Runs of letters longer than a word of the toxicity model count to their end."""

import numpy as np

from gridpanel.llm import toxicity


def test_pieces_hold_every_gram():
    rng = np.random.default_rng(1)
    for n in (1, 4, 5, 63, 64, 65, 68, 69, 124, 125, 126, 700):
        run = "".join(chr(0x4E00 + x) for x in rng.integers(0, 5000, n))
        pieces = toxicity.words(f"a {run} b")
        assert pieces[0] == "a" and pieces[-1] == "b" and max(map(len, pieces)) <= 64
        assert all(any(run[i : i + 5] in p for p in pieces) for i in range(max(1, n - 4)))
        if n <= 64:
            assert pieces == ["a", run, "b"]


def test_toxic_passage_behind_letter_64_is_found():
    rng = np.random.default_rng(2)
    clean = lambda n: "".join(chr(0x4E00 + x) for x in rng.integers(0, 400, n))
    bad = "".join(chr(0x6000 + x) for x in range(40))
    texts = [clean(90) + (bad if i % 2 else clean(40)) + clean(90) for i in range(400)]
    model = toxicity.train(texts, [i % 2 for i in range(400)])
    score = model.probability(model.margins([clean(200) + bad + clean(50), clean(290), "_".join(["ab"] * 100) + "_" + bad]))
    assert score[0] > 0.5 > score[1] and score[2] > 0.5
