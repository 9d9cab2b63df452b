"""Disguised words that toxicity scores have to see."""

from __future__ import annotations

import pytest

from voxelloom.llm import toxicity

ENGLISH = "you are such a stupid moron and the idiot in that tidy riot did not kill or edit it, what a pathetic worthless clown, hello to the loser with the scum, as an ass would pass " * 40
MODEL = toxicity.model_of(toxicity.letter_counts(ENGLISH).astype(float))
WORDS = ("idiot", "ass", "kill", "loser", "stupid", "scum", "hello", "moron", "clown", "worthless")
SCORER = toxicity.Scorer(MODEL, {f"={w}": 3.0 for w in WORDS})


@pytest.mark.parametrize(
    "written",
    ["idi07", "a55", "ki11", "105er", "57upid", "$7upid", "5(um", "hell0,", '"5tupid"', "(1diot)", "idi0t!", "i\td\ti\to\tt", "i  d  i  o  t"],
)
def test_look_alikes_anywhere(written):
    assert SCORER.features(f"the {written} there")[0] == 3.0


@pytest.mark.parametrize("written", ["w h a t a p a t h e t i c w o r t h l e s s c l o w n", "such a m o r o n", "y o u s t u p i d", "st" + "u" * 60 + "pid"])
def test_any_length(written):
    assert SCORER.features(written)[0] == 3.0


@pytest.mark.parametrize("size", [41, 99, 5000])
def test_nothing_is_cut_off(size):
    torn = " ".join("idiot" * (size // 5 + 1)) + " " + " ".join("clown")
    restored = toxicity.restore(torn, MODEL).replace(" ", "")
    assert restored.startswith("idiot") and restored.endswith("clown") and len(restored) >= size
    assert SCORER.features("that " + "stu" + "u" * size + "pid there")[0] == 3.0


def test_end_of_a_long_run():
    assert "clown" in list(toxicity.Reader(MODEL).words("w h a t a p a t h e t i c w o r t h l e s s c l o w n"))
    assert len(toxicity.restore("ab1" * 50_000, MODEL)) > 100_000


def test_plain_words_stay():
    assert list(toxicity.Reader(MODEL).words("stop! what? (such) 2010 1 2 3 4")) == ["stop", "what", "such", "", "", "", "", ""]
