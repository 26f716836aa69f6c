"""Decontamination: re-parameterised items of few words, conflicting slots, and boilerplate that many items share."""

from profseg.llm import decontam


def found(spark, docs, items, **settings):
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id, r.exact) for r in decontam.matches(docs, bench, **settings).collect()}


def test_items_of_few_words_with_other_values(spark):
    sums, weights = "What is 12 + 30 - 7 * 9 ?", "Anna has 12 kg , Bob has 9 kg , Carl has 7 kg , Dora has 5 kg"
    docs = ["Look. What is 14 + 31 - 8 * 6 ? Yes", "then Eva has 3 kg , Finn has 4 kg , Gina has 8 kg , Hugo has 1 kg .", "What is 14 and 31", "Eva has 3 kg , Finn has 4 kg and that is all", "1 2 3 4 5 6 7 8 9"]
    assert found(spark, docs, [sums, weights, "9 8 7 6 5 4 3 2 1"]) == {(0, 0, False), (1, 1, False)}


def test_values_of_few_words_must_be_consistent(spark):
    item = "What is 12 + 30 - 12 * 9 ?"
    assert found(spark, ["What is 14 + 31 - 14 * 6 ?", "What is 14 + 31 - 8 * 6 ?", item], [item]) == {(0, 0, False), (2, 0, True)}


ITEM = "If Anna buys 12 apples for 3 dollars and Bob buys 12 pears in the old market hall near the river, how many kg of fruit does Anna carry home today after they have shared all of it with the children of the house ?"


def test_stretches_between_conflicts(spark):
    one = ITEM.replace("12", "13", 1)
    assert found(spark, [one, ITEM], [ITEM]) == {(1, 0, True)}
    split = found(spark, [one, ITEM, "If Anna buys 12 apples"], [ITEM], split=True)
    assert {(d, i) for d, i, _ in split} == {(0, 0), (1, 0)}
    own = decontam.canonical(ITEM)
    item = (*own, decontam.first_as_name(ITEM, own[1]))
    tokens, slots = decontam.canonical(one)
    places = list(range(len(tokens) - 7))
    assert decontam.judge(item, tokens, slots, 0, places) is None
    n, share, same, n_slots = decontam.judge(item, tokens, slots, 0, places, split=True)
    conflict = [i for i, s in enumerate(own[1]) if s == "12"][1]
    assert n == max(conflict, len(tokens) - conflict) and same


def test_boilerplate_is_no_item(spark):
    words = "read the following passage with care and then choose the one answer that fits best among all of those given below by the author".split()
    shared = " ".join(words)
    questions = [f"why did the {a} {b} leave the quiet harbour before {c} came back from the hills" for a in ("grey", "old", "young", "tall", "poor") for b in ("sailor", "miller", "widow", "farmer", "priest") for c in ("snow", "rain", "winter", "autumn", "night")]
    items = [f"{shared} {q}" for q in questions]
    docs = [f"intro {shared} and nothing else of it" for _ in range(40)] + [f"{shared} {questions[7]}", "so " + questions[9] + " they asked"]
    got = {(d, i) for d, i, _ in found(spark, docs, items)}
    assert {d for d, _ in got} == {40, 41} and (40, 7) in got and (41, 9) in got
    assert len(found(spark, docs[:2], items, most_items=0)) == 2 * len(items)
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert sorted(r.doc_id for r in decontam.clean(frame, bench).collect()) == list(range(40))


def test_items_that_are_all_shared_windows(spark):
    """Many items of one template: found by the windows that the fewest hold."""
    items = [f"Tom has {i} red marbles and gives away {i + 1} of them to his best friend" for i in range(1, 60)]
    got = found(spark, ["Tom has 500 red marbles and gives away 700 of them to his best friend", "nothing here"], items)
    assert {d for d, _, _ in got} == {0} and len(got) == 59
