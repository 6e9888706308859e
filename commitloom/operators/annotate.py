"""Rule annotations and quality predicates on commit messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import message as M
from ..functions.text import bind

MAX_SUBJECT_LENGTH = 50
MIN_SUBJECT_WORDS = 3


def with_subject(commits: DataFrame, flavor: str = "v1", literal: bool = False) -> DataFrame:
    message = F.col("message")
    if flavor == "v1":
        subject = M.extract_subject_v1(message, literal)
    else:
        subject = M.extract_subject_v2(message)
    return commits.withColumn("subject", subject)


def annotate_rules(df: DataFrame, ignore_case: bool = True) -> DataFrame:
    """Add length, chore, bot and word-count columns to (subject, author) rows."""
    subject = F.col("subject")
    return df.withColumns(
        {
            "subject_length": M.subject_length(subject),
            "is_chore": M.is_chore(subject),
            "is_bot": M.is_bot(F.col("author"), ignore_case),
            "subject_word_count": M.word_count(subject),
        }
    )


def cheap_rules() -> Column:
    """The annotation rules that need no parser."""
    return (
        ~F.col("is_bot")
        & ~F.col("is_chore")
        & (F.col("subject_length") <= MAX_SUBJECT_LENGTH)
        & (F.col("subject_word_count") >= MIN_SUBJECT_WORDS)
    )


def requirements_mask(vo: str = "either") -> Column:
    """Whether an annotated commit fits the requirements.

    ``vo='either'`` accepts a pass of either verb-object rule; ``vo='compat'`` looks
    at the first one only. A rule that was not evaluated counts as not passed.
    """
    if vo not in ("either", "compat"):
        raise ValueError(f"vo must be 'either' or 'compat', not {vo!r}")
    first = F.coalesce(F.col("verb_object_spacy"), F.lit(False))
    return cheap_rules() & (either_verb_object() if vo == "either" else first)


def drill_cheap_rules(author: Column, subject: Column) -> Column:
    """The drilled-commit rules that need no parser; bots match case-sensitively."""
    return ~M.is_bot(author, ignore_case=False) & bind(
        subject,
        lambda s: ~M.is_chore(s)
        & M.subject_length(s).between(1, MAX_SUBJECT_LENGTH)
        & (M.word_count(s) >= MIN_SUBJECT_WORDS),
    )


def either_verb_object() -> Column:
    """Either verb-object flag is set; a flag that was not evaluated counts as not set."""
    return F.coalesce(F.col("verb_object_spacy"), F.lit(False)) | F.coalesce(
        F.col("verb_object_stanza"), F.lit(False)
    )


def commit_quality_filter(commits: DataFrame) -> DataFrame:
    """Drilled commits whose (author, subject) pass the rules and either verb-object flag."""
    cheap = drill_cheap_rules(F.col("author"), F.col("subject"))
    return commits.where(cheap).where(either_verb_object())


def reapply_rules(annotated: DataFrame, vo: str = "either") -> DataFrame:
    """Recompute rules and mask from the stored subject and flags, then drop incomplete rows.

    The verb-object flags may be null (not evaluated); they do not make a row incomplete.
    """
    stored = annotated.drop("fits_requirements")
    renewed = annotate_rules(stored).withColumn("fits_requirements", requirements_mask(vo))
    flags = ("verb_object_spacy", "verb_object_stanza")
    return renewed.na.drop("any", subset=[c for c in renewed.columns if c not in flags])
