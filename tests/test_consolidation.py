"""Facts of conversations: dates, density and their order, against plain expectations."""

import datetime as dt

import pytest

from mnemospark.operators import consolidation as CO

A = dt.date(2023, 5, 8)  # a Monday


@pytest.mark.parametrize(
    "text, want",
    [
        ("It broke Yesterday", "2023-05-07"), ("2 weeks ago we met", "2023-04-24"), ("1 month ago", "2023-04-08"), ("10 years ago", "2013-05-10"), ("last week", "2023-05-01"), ("a week ago", "2023-05-01"), ("a month ago", "2023-04-08"),
        ("last year, yesterday", "2023-05-07"), ("LAST YEAR", "2022"), ("see you friday", "2023-05-05"), ("last monday", "2023-05-01"), ("next sunday", "2023-05-07"), ("nothing", None), ("mondays", None), ("99999999 days ago", None),
    ],
)
def test_refers_to(text, want):
    assert CO.refers_to(text, A) == want


@pytest.mark.parametrize("text, want", [("[Session date: 1:56 pm on 8 May, 2023]", A), ("Session date: on 8 May 2023", A), ("[Session date: 40 May, 2023]", None), ("[Session date: 8 Mai, 2023]", None), ("8 May, 2023", None), ("", None)])
def test_session_date(text, want):
    assert CO.session_date(text) == want


def test_density_and_words():
    assert CO.density("We met Anna on 8 May 2023 with 7 friends") == 4 + 2 * 3 + 2
    assert CO.density("Anna says no") == 0
    assert CO.at_word("one two three", 9) == "one two" and CO.at_word("x" * 12, 5) == "xxxxx" and CO.at_word("ab", 5) == "ab"


def turns(spark):
    rows = [
        (1, 0, None, "[Session date: 1:56 pm on 8 May, 2023]"), (1, 1, "ann", "Hello there, how are you doing today? I moved to Berlin on 3 March 2021 with 2 cats."), (1, 2, "bob", "We talked about it yesterday, as you know."), (1, 3, "ann", "we talked about it YESTERDAY, as you know."),
        (1, 4, None, "[Session date: 9:00 am on 10 June, 2023]"), (1, 5, "bob", "I saw it 3 days ago near the old river bank."), (1, 6, "bob", "  "), (1, 7, None, None), (2, 0, None, "Nobody said this in a session without a date."), (3, 0, None, "[Session date: 9:00 am on 10 June, 2023]"),
    ]
    return spark.createDataFrame(rows, "conv_id long, turn long, speaker string, text string")


def test_turns_are_facts_as_they_stand(spark):
    got = [(r.conv_id, r.place, r.turn, r.span, r.refers_to) for r in CO.dated_facts(turns(spark), "turns").orderBy("conv_id", "place").collect()]
    assert got == [
        (1, 1, 1, "(around 2023-05-08) [ann] Hello there, how are you doing today? I moved to Berlin on 3 March 2021 with 2 cats.", None),
        (1, 2, 2, "(around 2023-05-08) [bob] We talked about it yesterday, as you know. [date: 2023-05-07]", "2023-05-07"),
        (1, 3, 5, "(around 2023-06-10) [bob] I saw it 3 days ago near the old river bank. [date: 2023-06-07]", "2023-06-07"),
        (2, 1, 0, "Nobody said this in a session without a date.", None),
    ]
    assert CO.dated_facts(turns(spark).limit(0)).count() == 0


def test_sentences_by_density(spark):
    got = [(r.conv_id, r.place, r.turn, r.density, r.subject) for r in CO.dated_facts(turns(spark), "sentences").orderBy("conv_id", "place").collect()]
    assert got == [(1, 1, 1, 12, "ann"), (1, 2, 5, 2, "bob"), (1, 3, 1, 0, "ann"), (1, 4, 2, 0, "bob"), (2, 1, 0, 0, "Nobody")]
    few = CO.dated_facts(turns(spark), "sentences", 3).where("conv_id = 1").orderBy("place").collect()
    assert [r.turn for r in few] == [1, 5]  # half of three is one place for sentences without a date, number or name, and it is gone
