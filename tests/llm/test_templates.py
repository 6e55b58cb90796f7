"""What an index of benchmark items finds in single texts."""

import random

from tarn.llm.decontaminate import Index


def found(item, text):
    index = Index([(1, item)])
    return [(cover, verbatim) for _, cover, verbatim in index.hits(text, index.forms())]


def test_slots_of_several_tokens():
    item = "A tank holds 3.5 litres and loses 0.2 litres per hour, how many hours until 1.1 litres remain?"
    assert found(item, item.replace("3.5", "12").replace("0.2", "2").replace("1.1", "4")) == [(1.0, False)]
    assert found(item.replace("3.5", "1,000"), item) == [(1.0, False)]
    assert found(item, item) == [(1.0, True)]
    item = "A train leaves New York at 9 and a second train reaches New York at 11, how long is New York without a train?"
    assert found(item, item.replace("New York", "London").replace("9", "8")) == [(1.0, False)]
    assert found(item.replace("New York", "London"), item) == [(1.0, False)]
    assert found(item, item) == [(1.0, True)]
    # a number ends with its digits
    item = "The box weighs 5. Then 6 more stones are put in, so what does it weigh now in all?"
    assert found(item, item.replace("5", "7.25").replace("6", "1,5")) == [(1.0, False)]


def test_a_conflict_leaves_the_other_windows():
    # 23 words and 16 windows, of which 7 hold one of the slots that contradict each other; 12 more words: 28 windows, 11
    item = "Tom has 5 apples and buys 7 more apples for 3 dollars today. How many apples has Tom after 5 weeks in all?"
    longer = item + " please write down each step of the work that you have done."
    assert found(item, item.replace("5 apples", "6 apples")) == []
    assert found(longer, longer.replace("5 apples", "6 apples")) == [((28 - 11) / 28, False)]
    # two values become one
    assert found(longer, longer.replace("7", "3")) == [((28 - 11) / 28, False)]
    # the more frequent of the pairs stands
    item = "Put 5 red stones into one box and then put 5 blue stones into one more box and then take 5 stones out of each box."
    assert found(item, item.replace("5 red", "6 red")) == [(17 / 19, False)]
    # no slot stands
    other = "Ann took {} of {} and {} of {} and {} of {} and {} of {} and {} of {} and all was well"
    assert found(other.format(*"1111111111"), other.format(*"2345678923")) == []


def test_short_items():
    item = "What is the boiling point of pure water?"
    for text in ("Question: {}", "Quiz - {}", "Answer this {}", "Say what! {}", "({})", "1) {}", "He asked \u201c{}\u201d", "{}"):
        assert found(item, text.format(item)) == [(1.0, True)], text
    assert found(item, "Question: " + item.replace("pure", "sea")) == []
    # the first word is a name: another one, of one word or two, opens the sentence or stands in it
    item = "Tom has 5 red apples and 7 pears now."
    for name in ("Ann", "Tom"):
        for text in ("So. {}", "Note: {}", "Now {}"):
            assert found(item, text.format(item.replace("Tom", name))) == [(1.0, name == "Tom")], (name, text)
    assert found(item, "Note: " + item.replace("Tom", "New York")) == [(1.0, False)]
    assert found(item.replace("Tom", "New York"), "Note: " + item) == [(1.0, False)]


def test_items_without_a_template():
    assert found("What is 12 times 7?", "Question: what is 12 times 7? 84") == [(1.0, True)]
    assert found("What is 12 times seven?", "Question: What is 12 times seven? 84") == [(1.0, True)]
    assert found("What is 12 times 7?", "What is 12 times 8?") == []
    assert found("3.5 + 4", "How much is 3.5 + 4?") == [(1.0, True)]
    assert found("", "What?") == [] and found("What is 12?", "") == []
    index = Index([(1, "too short"), (2, "too short"), (2, "too short"), (3, None)])
    assert [i for i, _, _ in index.hits("It is too short.", index.forms())] == [1, 2, 2]


def test_long_excerpts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(500)]
    item = " ".join(words)
    assert found(item, "Intro. " + " ".join(words[100:350]) + " end") == [(243 / 493, True)]
    assert found(item, "Intro. " + " ".join(words[100:121]) + " end") == [(14 / 493, True)]
    assert found(item, "Intro. " + " ".join(words[100:120]) + " end") == []
    assert found(item, " x ".join(" ".join(words[i : i + 20]) for i in range(0, 200, 25))) == []
    # slots with other values do not add to the length
    words[110:130] = map(str, range(10, 30))
    assert found(" ".join(words), " ".join([*words[100:110], *map(str, range(40, 60)), *words[130:140]])) == []
    assert found(" ".join(words), " ".join([*words[90:110], *map(str, range(40, 60)), *words[130:140]])) == [(43 / 493, False)]
