"""The chain of decisions: golden rows, each rule, odd rows."""

import pytest

from docmill.operators import decided as d

FIRST = "אישור תקציב החינוך הוחלט לאשר. בעד/נגד/נמנע: 9/1/0"
SECOND = "מינוי ועדת ביקורת אושר פה אחד"


@pytest.mark.parametrize(
    "text,want",
    [
        ("הוחלט לאשר תקציב. בעד/נגד/נמנע: 9/1/0", (9, 1, 0, False, False, 0.96, "slash")),
        ("תוצאה: בעד 7 נגד 2 נמנעים 1", (7, 2, 1, False, False, 0.94, "counts")),
        ("תוצאה: בעד 7 נגד 2", (7, 2, None, False, False, 0.94, "counts")),
        ("הסעיף אושר פה אחד", (None, None, None, True, False, 0.92, "unanimous_phrase")),
        ("התקיים דיון: בעד ונגד אך ללא מספרים", (None, None, None, None, True, 0.4, "uncertain")),
        ("אין הצבעה", None), ("  ", None),
    ],
)
def test_votes(text, want):
    assert d.parse_vote(text) == want


def test_numbered_decisions_of_a_section():
    text = "\n".join(["ישיבת מועצה רגילה", "סיכום והחלטות", f"1. {FIRST}", f"2. {SECOND}"])
    got = d.decisions_in(text)
    assert [(x.number, x.text) for x in got] == [("1", FIRST), ("2", SECOND)]
    assert got[0].vote[:3] == (9, 1, 0) and got[1].vote[3] is True
    # .45, a section .2, a number .15, a verb .15, a vote .05
    assert [x.confidence for x in got] == [1.0, 1.0] and [text[x.start : x.end] for x in got] == [f"1. {FIRST}", f"2. {SECOND}"]


def test_outside_a_section_only_verbs_decide():
    text = "1. שורה ארוכה מאוד בלי שום פועל של החלטות כאן\nהוחלט לאשר את התקציב\nהמשך השורה\n\nעוד שורה"
    assert [x.text for x in d.decisions_in(text.replace("החלטות ", ""))] == ["הוחלט לאשר את התקציב המשך השורה"]


def test_items_go_on_for_three_lines_at_most():
    text = "סיכום והחלטות\n1. הוחלט לאשר את\nא\nב\nג\nד\n2. הוחלט לדחות את ההצעה"
    assert [x.text for x in d.items(text)] == ["הוחלט לאשר את א ב ג", "הוחלט לדחות את ההצעה"]


def test_rows_of_tables_have_an_agenda_item():
    got = d.items("סיכום והחלטות\nחינוך | הוחלט לאשר את התקציב השנתי | מיידי\nנושא ההחלטה | תוכן ההחלטה")
    assert [(x.agenda, x.text, x.confidence) for x in got] == [("חינוך", "הוחלט לאשר את התקציב השנתי", 0.9)]


def test_equal_decisions_count_once_and_double_ones_are_split():
    twice = "הוחלט לאשר את תקציב החינוך השנתי"
    both = twice + " כמו כן מאשרים את תקציב הרווחה"
    text = f"סיכום והחלטות\n1. {twice}\n2. {twice}\n3. {both}"
    got = d.decisions_in(text)
    assert [(x.number, x.text) for x in got] == [("1", twice), ("3", f"3. {twice}"), ("3", "מאשרים את תקציב הרווחה")]
    assert text[got[2].start : got[2].end] == "מאשרים את תקציב הרווחה"


def test_the_number_in_the_text(spark):
    assert [x.number for x in d.items("החלטה מס' 12/24 לאשר את ההסכם")] == ["12/24"]


def test_rows(spark):
    text = f"סיכום והחלטות\n1. {FIRST}"
    rows = [(1, text, "c"), (2, None, "c"), (3, "", "c"), (None, text, "c"), (1, text, "c"), (4, "x" * 2000 + "\n" + "שורה\n" * 50000 + "הוחלט לאשר את הכל", "c")]
    got = sorted((str(r.doc_id), r.nth, r.yes, r.pattern, r.text) for r in d.find_decisions(spark.createDataFrame(rows, "doc_id long, text string, number string")).collect())
    assert got == [("1", 0, 9, "slash", FIRST)] * 2 + [("4", 0, None, None, "הוחלט לאשר את הכל")] + [("None", 0, 9, "slash", FIRST)]
