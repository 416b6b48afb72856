"""The chain is trained: without its weights boundaries are lost, and each kind of weight decides places."""

import itertools
import math
import random

import pytest

from leafmill.llm import sentences
from tests.llm.test_llm import CASES


def found(model):
    """Units of the hand-made cases that a model finds, and how many there are."""
    right = total = 0
    for text, units in CASES:
        ends, at = [], 0
        for unit in units or []:
            at = text.index(unit, at) + len(unit)
            ends.append(at)
        total += len(ends)
        right += len(set(ends) & set(sentences.text_ends(text, model)))
    return right, total


def test_weights_decide():
    trained = sentences.SentenceModel(pauses={"گاهی"})
    right, total = found(trained)
    assert right == total
    assert found(sentences.SentenceModel(weights={}, steps={}))[0] < 0.7 * total


def test_seeds_are_learned():
    for seed in sentences.SEEDS:
        parts = seed.split("|")
        want = [len("".join(parts[:k])) for k in range(1, len(parts) + 1)]
        assert sentences.line_ends("".join(parts), sentences.SentenceModel()) == want


def test_thai_spaces_are_trained(spark):
    line = "คนเฝ้าประตูหลับ ไม่มีใครมา หนัก 4 กิโลกรัม"
    texts = spark.createDataFrame([(k, "ไม่มีใครมา!\nเรือออกช้า ๆ แล้ว\nคนหลับ\nเรือออก 12 ครั้ง") for k in range(20)], "doc_id long, text string")
    model = sentences.fit(texts)
    assert sentences.line_ends(line, model) == [15, 26, len(line)]
    for cue in [c for c in model.weights if c.startswith("space:")]:
        del model.weights[cue]
    assert sentences.line_ends(line, model) != [15, 26, len(line)]


@pytest.mark.parametrize("seed", range(30))
def test_decoding_equals_every_path(seed):
    rng = random.Random(seed)
    model = sentences.SentenceModel(weights={c: rng.uniform(-2, 2) for c in "abc"}, steps={(k, a, b): rng.uniform(-2, 2) for k in (False, True) for a in (0, 1) for b in (0, 1)})
    places = [(k, tuple(rng.sample("abc", rng.randint(0, 2))), rng.random() < 0.4) for k in range(6)]

    def score(tags):
        return sum(model.steps[linked, a, b] + b * sum(model.weights[c] for c in cues) for (_, cues, linked), a, b in zip(places, (1, *tags), tags, strict=False))

    paths = list(itertools.product((0, 1), repeat=6))
    ends = sentences._decode(places, model)
    assert abs(score(tuple(int(k in ends) for k in range(6))) - max(map(score, paths))) < 1e-9
    # expected counts by forward and backward sums
    shares = {}
    sentences._sums(tuple((cues, linked, None) for _, cues, linked in places), model, False, lambda name, x: shares.__setitem__(name, shares.get(name, 0.0) + x))
    total = sum(math.exp(score(p)) for p in paths)
    for cue in "abc":
        want = sum(math.exp(score(p)) * sum(b for (_, cues, _), b in zip(places, p, strict=True) if cue in cues) for p in paths) / total
        assert abs(shares.get(cue, 0.0) - want) < 1e-9
