"""Windows of many texts at once: those of each text alone, for little more work than one text takes."""

import random
import re

import numpy as np

from tarn.llm import decontaminate as D

TEXTS = [None, "", ".!?\n", "Tom", "Tom has 3.5 km.", "3.", ".5 and 1,000.25 of it", "a_b 3_.5 x_3.5_y", "² ٣.٤ 5.² Ünit ΣΊΣΥΦΟΣ İstanbul ǅungla", "New York New York", "one two three four five six seven", "Ann one two three four five six seven", "word " * 3000, "7.7.7,7.a9.9_9 9.a"]


def every(hashes):
    return np.ones(len(hashes), bool)


def windows(texts, sizes=(3, 8), plain=(1, 2, 8)):
    return sorted(D.text_windows(texts, D.Forms(), sizes, plain, every))


def test_words_are_those_of_the_pattern():
    rng = random.Random(5)
    for text in filter(None, [*TEXTS, *("".join(rng.choices("aB3٣²_., !\né中", k=60)) for _ in range(500))]):
        assert D.split(text) == re.findall(D._TOKEN, text)


def test_texts_together_give_the_windows_of_each_alone(monkeypatch):
    rng = random.Random(6)
    texts = [*TEXTS, *(" ".join(rng.choices(["Tom", "Ann", "5", "km", "is", "a", ".", "?\n", "b.c", "9,9"], k=rng.randint(0, 20))) for _ in range(300))]
    alone = sorted((n, *w) for n, text in enumerate(texts) for _, *w in windows([text]))
    assert windows(texts) == alone
    for group in (1, 50):
        monkeypatch.setattr(D, "GROUP", group)
        assert windows(texts) == alone


def test_short_texts_are_cut_together(monkeypatch):
    """Ten words: three windows, and the first once more with Tom as a name."""
    calls = []
    whole = D.template
    monkeypatch.setattr(D, "template", lambda *a: calls.append(1) or whole(*a))
    assert len(windows(["Tom has 5 apples and buys 7 more pears today."] * 500, (8,), ())) == 500 * 4
    assert len(calls) == 1


def test_a_plain_word_has_the_id_of_its_letters():
    """Plain windows take the ids that the words have already, but those of numbers and units."""
    text = "Tom ran 5 km in New York"
    low = text.lower().split()
    assert [h for _, h, *_ in D.text_windows([text], D.Forms(), (), (1,), every)] == D._at(D._plain(low), np.arange(len(low)), 1, D._WEIGHTS).view(np.int64).tolist()
