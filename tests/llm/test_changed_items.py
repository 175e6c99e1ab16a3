"""Benchmark items with other numbers, units and names, where placeholders stand close together."""

import pytest

from sojourn.llm import decontaminate

DENSE = "Anna bought {} kg apples and {} kg pears for {} dollars"
STARTS = "{0} has {1} apples. {0} buys {2} apples. How many apples does {0} have?"
LONGER = "If {0} has {1} apples and then gives {2} apples to {3}, how many apples are left with {0}?"
NUMBERS = "1 2 3 5 8 13 21 34 55 89 144 233 377 610"


def found(spark, item, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(2, item)], "item_id long, text string")
    return [(r["doc_id"], r["item_id"], r["exact"]) for r in decontaminate.leaks(docs, items).collect()]


@pytest.mark.parametrize(
    "item, text",
    [
        (DENSE.format(3, 5, 20), DENSE.format(4, 6, 30)),
        (STARTS.format("Tom", 3, 5), STARTS.format("Sam", 4, 9)),
        (STARTS.format("Tom", 3, 5), "Question: " + STARTS.format("Sam", 4, 9) + " Answer: 13"),
        (LONGER.format("Tom", 3, 2, "Ben"), LONGER.format("Mary Ann", 4, 1, "Lee Roy")),
    ],
)
def test_changed(spark, item, text):
    assert found(spark, item, text) == [(1, 2, False)]


@pytest.mark.parametrize(
    "item, text, want",
    [
        (NUMBERS, "so " + NUMBERS + " then", [(1, 2, True)]),
        (NUMBERS, "so " + NUMBERS.replace("8", "7") + " then", []),
        (STARTS.format("Tom", 3, 5), STARTS.format("Sam", 4, 9).replace("Sam", "Bob", 1), []),
        (DENSE.format(3, 5, 20), "Then 4 kg of 6 kg went for 30 dollars and Carl got 4 kg pears and 6 kg more", []),
    ],
)
def test_values_and_strangers(spark, item, text, want):
    assert found(spark, item, text) == want
