import pyarrow as pa
import pytest
from pulsegrid.llm import decontam as D
from pulsegrid.llm.textkernel import bytes_of

AROUND = "some ordinary text that stands before it and goes on, "


def leaks(item, text):
    return list(D.Index([(1, item)]).leaks(*bytes_of(pa.array([text]))))


@pytest.mark.parametrize("item", ["what is 12 plus 15", "compute 12 45 7 3 and give 9 digits", "add 7 and two", "the Old Bridge Of Many Stones", "then 1 2 3 4 5 6 7 8 9 10 11 12 13"])
def test_copies_of_items_with_few_literals_leak(item):
    found = leaks(item, AROUND + item + " and more")
    assert len(found) == 1 and found[0][3] == 1.0 and not found[0][4]


def test_few_literals_with_other_values_do_not():
    assert not leaks("what is 12 plus 15", AROUND + "what is 13 plus 15 and more")


def test_a_long_copied_run_leaks_whatever_its_share():
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    found = leaks(" ".join(words), AROUND + " ".join(words[30:130]) + " end")
    assert len(found) == 1 and found[0][3] == 0.5
    assert not leaks(" ".join(words), AROUND + " ".join(words[30:60]) + " end")
    pieces = " so ".join(" ".join(words[i : i + 10]) for i in range(0, 100, 20))
    assert not leaks(" ".join(words), pieces)


@pytest.mark.parametrize("before", ["Q1) ", AROUND + "asked, ", "", "First. "])
@pytest.mark.parametrize("item", ["What is the capital of France?", "Anna has 5 apples and buys 3 more", "Who wrote the book. The Old Man knows"])
def test_short_capitalised_items_inside_a_line(item, before):
    found = leaks(item, before + item + " and more")
    assert len(found) == 1 and found[0][3] == 1.0 and not found[0][4]


@pytest.mark.parametrize("before", ["", AROUND, "Q1) "])
def test_short_questions_that_begin_with_a_name_and_have_new_parameters(before):
    found = leaks("Anna has 5 apples and buys 3 more", before + "Maria has 7 apples and buys 2 more")
    assert len(found) == 1 and found[0][4]
    assert leaks("What is the capital of France?", before + "What is the capital of Spain?")[0][4]
    assert not leaks("Anna has 5 apples and buys 3 more", before + "Maria has 7 pears and buys 2 more")
