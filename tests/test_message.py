import random

import pytest

from commitloom.functions import message as M
from commitloom.functions import text as T

# message, v1 subject, v1 length, v1 words, v1 chore, v2 subject
GOLDEN = [
    ("Fix: add retry to client", "add retry to client", 19, 4, False, "fix: add retry to client"),
    ("feat(core): support x: y mode", "y mode", 6, 2, False, "feat(core): support x: y mode"),
    ("Add parser (#1234)", "add parser", 10, 2, False, "add parser"),
    ("Add parser #1234", "add parser", 10, 2, False, "add parser #1234"),
    ("See (#123456)", "see (6)", 7, 2, False, "see (#123456)"),
    ("Add parser.", "add parser", 10, 2, False, "add parser"),
    ("Add parser. ", "add parser.", 11, 2, False, "add parser."),
    ("Merge branch main", "merge branch main", 17, 3, True, "merge branch main"),
    ("", "", 0, 0, False, ""),
    ("fix #123 typo", "fix #123 typo", 13, 3, False, "fix #123 typo"),
    ("Add parser\r\nbody", "add parser", 10, 2, False, "add parser"),
    ("Add\x0bparser now", "add\x0bparser now", 14, 3, False, "add"),
    ('Add r"#1234 parser', 'add r" parser', 13, 3, False, "add  parser"),
    ("\nbody", "", 0, 0, False, ""),
]


def test_golden_subjects(values):
    messages = [row[0] for row in GOLDEN]
    assert values(messages, "string", M.extract_subject_v1) == [row[1] for row in GOLDEN]
    assert values(messages, "string", M.extract_subject_v2) == [row[5] for row in GOLDEN]


def test_golden_rules(values):
    subjects = [row[1] for row in GOLDEN]
    assert values(subjects, "string", M.subject_length) == [row[2] for row in GOLDEN]
    assert values(subjects, "string", M.word_count) == [row[3] for row in GOLDEN]
    assert values(subjects, "string", M.is_chore) == [row[4] for row in GOLDEN]


def test_chore_is_a_plain_prefix(values):
    subjects = ["merged two", "bumpy road", "rollbacks", "a merge", "Merge x"]
    assert values(subjects, "string", M.is_chore) == [True, True, True, False, False]


def test_literal_patterns_change_nothing(values):
    got = values(["Fix: x (#1234)."], "string", lambda m: M.extract_subject_v1(m, literal=True))
    assert got == ["fix: x (#1234)"]


def test_bot_case(values):
    authors = ["dependabot[bot]", "X[BOT]", "[bot] x"]
    assert values(authors, "string", M.is_bot) == [True, True, False]
    got = values(authors, "string", lambda a: M.is_bot(a, ignore_case=False))
    assert got == [True, False, False]


def test_prompts(values):
    assert values([" a \n b "], "string", M.message_prompt) == ["<msg>  a \n b "]
    got = values([" a \n b "], "string", lambda m: M.message_prompt(m, collapse=True))
    assert got == ["<msg> a b"]


def test_null_stays_null(values):
    assert values([None], "string", M.extract_subject_v1) == [None]
    assert values([None], "string", M.extract_subject_v2) == [None]


ALPHABET = "ab:.#(1)2[ \t\n\r\x0b\x0c\x1c\x1f\x85\xa0    　é漢"


@pytest.fixture(scope="module")
def noise():
    draw = random.Random(11)
    return ["".join(draw.choices(ALPHABET, k=draw.randint(0, 24))) for _ in range(2000)]


def test_whitespace_agrees_with_python(values, noise):
    assert set(T.WHITESPACE_CHARS) == {chr(c) for c in range(0x110000) if chr(c).isspace()}
    assert values(noise, "string", T.strip) == [s.strip() for s in noise]
    assert values(noise, "string", T.words) == [s.split() for s in noise]
    assert values(noise, "string", T.squeeze) == [" ".join(s.split()) for s in noise]


def test_every_whitespace_character_splits(values):
    texts = [f"a{chr(c)}b" for c in range(0x3100) if not 0xD800 <= c < 0xE000 and c]
    assert values(texts, "string", M.word_count) == [len(t.split()) for t in texts]


def test_first_line_agrees_with_python(values, noise):
    want = [(s.splitlines() or [""])[0] for s in noise]
    assert values(noise, "string", T.first_line) == want
