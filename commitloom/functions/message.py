"""Commit-message columns: subject, rule annotations and model prompts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_line, squeeze, strip, words

# Patterns and word lists the subject rules are defined by.
SUBJECT_PREFIX = r"^[^\n]+:"
ISSUE_ID = r"#[0-9]{4,5}|\(#[0-9]{4,5}\)"
DRILL_ISSUE_ID = r'r"#[0-9]{4,5}|\(#[0-9]{4,5}\)'
CHORE_PREFIXES = ("merge", "bump", "rollback")
BOT_SUFFIX = "[bot]"
MESSAGE_MARKER = "<msg>"


def _finish_subject(text: Column) -> Column:
    """Drop one trailing dot, then surrounding whitespace (a dot before blanks stays)."""
    return strip(F.regexp_replace(text, r"\.\z", ""))


def extract_subject_v1(message: Column, literal: bool = False) -> Column:
    """Subject of an API commit message.

    ``literal=True`` reads the two clean-up patterns as plain text, which never
    occurs in a message: prefix and issue ids then stay.
    """
    subject = F.lower(F.substring_index(message, "\n", 1))
    if not literal:
        subject = F.regexp_replace(subject, SUBJECT_PREFIX, "")
        subject = F.regexp_replace(subject, ISSUE_ID, "")
    return _finish_subject(subject)


def extract_subject_v2(message: Column) -> Column:
    """Subject of a drilled commit: any line break ends it, prefixes and bare ids stay."""
    subject = F.lower(first_line(message))
    return _finish_subject(F.regexp_replace(subject, DRILL_ISSUE_ID, ""))


def subject_length(subject: Column) -> Column:
    return F.char_length(subject)


def is_chore(subject: Column) -> Column:
    """Starts with a chore word; a plain prefix, so 'merged' counts."""
    return reduce(or_, [subject.startswith(prefix) for prefix in CHORE_PREFIXES])


def is_bot(author: Column, ignore_case: bool = True) -> Column:
    return (F.lower(author) if ignore_case else author).endswith(BOT_SUFFIX)


def word_count(subject: Column) -> Column:
    return F.size(words(subject))


def message_prompt(message: Column, collapse: bool = False) -> Column:
    """Message behind its marker; ``collapse`` squeezes whitespace as evaluation does."""
    return F.concat(F.lit(MESSAGE_MARKER + " "), squeeze(message) if collapse else message)


def source_prompt(language: Column, patch: Column) -> Column:
    return F.concat(F.lit("Summarize "), language, F.lit(": "), patch)
