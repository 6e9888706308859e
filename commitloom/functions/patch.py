"""File and patch columns: languages, tagged diff text, content classes.

The files of a commit stay one array per row, so nothing in here shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import LINE_BREAK_BUT_NEWLINE, bind

# Extension -> language, per flavor.
API_LANGUAGES = {
    "java": "Java",
    "py": "Python",
    "js": "Javascript",
    "php": "PHP",
    "rb": "Ruby",
    "go": "Go",
    "md": "Text",
}
DRILL_LANGUAGES = {
    "py": "Python",
    "java": "Java",
    "js": "JavaScript",
    "go": "Go",
    "php": "PHP",
    "rb": "Ruby",
    "md": "Markdown",
}
RAW_LANGUAGES = {
    "java": "Java",
    "py": "Python",
    "js": "Javascript",
    "php": "PHP",
    "rb": "Ruby",
    "go": "Go",
}
NATURAL_LANGUAGE = "Markdown"
OTHER_LANGUAGE = "Other"

# Markers of the tagged text and the special tokens, in removal order.
KEPT, ADDED, DELETED, PATH = "<ide>", "<add>", "<del>", "<path>"
SPECIAL_TOKENS = ("<msg>", "<pad>", "<s>", "</s>", "<mask>", "<unk>")
HUNK_HEADER = r"@@[^@\n]*@@"

FLAVORS = ("v1", "v2")


def _check_flavor(flavor: str) -> None:
    if flavor not in FLAVORS:
        raise ValueError(f"flavor must be one of {FLAVORS}, not {flavor!r}")


def _lookup(key: Column, table: dict[str, str]) -> Column:
    """CASE chain over a handful of entries; null for any other key."""
    result = None
    for value, label in table.items():
        result = (F if result is None else result).when(key == value, F.lit(label))
    return result


def language_v1(filename: Column) -> Column:
    """Language by path suffix: hidden names and a trailing dot have none; case counts."""
    suffix = F.regexp_extract(filename, r"[^/]\.([^./]+)/*\z", 1)
    return _lookup(suffix, API_LANGUAGES)


def language_v2(filename: Column) -> Column:
    """Language by the text after the last dot, or by the whole name without one."""
    return _lookup(F.substring_index(filename, ".", -1), DRILL_LANGUAGES)


def language_raw(filename: Column, compat: bool = False) -> Column:
    """Language of one raw file row; ``compat`` keeps the failing lookup: always 'Other'."""
    if compat:
        return F.when(filename.isNotNull(), F.lit(OTHER_LANGUAGE))
    known = _lookup(F.substring_index(filename, ".", -1), RAW_LANGUAGES)
    return F.when(filename.isNotNull(), F.coalesce(known, F.lit(OTHER_LANGUAGE)))


def path_header_v1(file: Column) -> Column:
    """Header lines of an API file: one line, or new and old path of a rename."""
    name, previous = file["filename"], file["previous_filename"]
    return F.when(
        previous.isNull(), F.array(F.concat(F.lit(KEPT + PATH), name))
    ).otherwise(
        F.array(F.concat(F.lit(ADDED + PATH), name), F.concat(F.lit(DELETED + PATH), previous))
    )


def path_header_v2(file: Column) -> Column:
    """Header lines of a drilled file; a missing path prints as 'None'."""
    before, after = file["path_before"], file["path_after"]
    shown_before, shown_after = F.coalesce(before, F.lit("None")), F.coalesce(after, F.lit("None"))
    return F.when(
        before.eqNullSafe(after), F.array(F.concat(F.lit(KEPT + PATH), shown_before))
    ).otherwise(
        F.array(
            F.concat(F.lit(ADDED + PATH), shown_after),
            F.concat(F.lit(DELETED + PATH), shown_before),
        )
    )


def _tagged_lines(patch: Column) -> Column:
    """Tagged lines of a patch as text, each behind a newline; '' when no line is left.

    Works on the whole text in one chain: line breaks become newlines, hunk headers and
    empty lines go, then every line gets a tag. A line tagged as kept is retagged only by
    its own first character, so tag-like text inside a diff is never touched.
    """
    text = F.concat(F.lit("\n"), patch)
    text = F.regexp_replace(text, LINE_BREAK_BUT_NEWLINE, "\n")
    text = F.regexp_replace(text, HUNK_HEADER, "")
    text = F.regexp_replace(text, r"\n(?=\n|\z)", "")
    return _replace_in_turn(
        text,
        [
            ("\n", "\n" + KEPT),
            ("\n" + KEPT + "+", "\n" + ADDED),
            ("\n" + KEPT + "-", "\n" + DELETED),
        ],
    )


def tag_patch(patch: Column) -> Column:
    """Tagged lines of a patch as an array."""
    return F.array_remove(F.split(_tagged_lines(patch), "\n"), "")


def serialize_commit(files: Column, flavor: str = "v1") -> Column:
    """Header and tagged lines of all files as one text; null if any patch is missing."""
    _check_flavor(flavor)
    header = path_header_v1 if flavor == "v1" else path_header_v2
    texts = F.transform(
        files, lambda f: F.concat(F.array_join(header(f), "\n"), _tagged_lines(f["patch"]))
    )
    return F.when(complete_patches(files), F.array_join(texts, "\n"))


def _replace_in_turn(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for found, put in pairs:
        text = F.replace(text, F.lit(found), F.lit(put))
    return text


def scrub_special(patch: Column) -> Column:
    """Delete the special tokens one after the other: an earlier deletion can form a later token."""
    return _replace_in_turn(patch, [(token, "") for token in SPECIAL_TOKENS])


def untag(patch: Column) -> Column:
    """Tags back to plain diff signs, for models that never saw the tags."""
    return _replace_in_turn(patch, [(DELETED, "-"), (ADDED, "+"), (KEPT, "")])


def repo_key(owner: Column, repo: Column) -> Column:
    return F.concat(owner, F.lit("-"), repo)


def repo_id(full_name: Column) -> Column:
    """'owner/repo' as one path-safe key."""
    return F.replace(full_name, F.lit("/"), F.lit("-"))


def languages(files: Column, language: Callable[[Column], Column] = language_v1) -> Column:
    # by the name field alone, so that a scan for it leaves the patches unread
    return F.transform(files["filename"], language)


def all_files_supported(files: Column, flavor: str = "v1") -> Column:
    """No file of an unsupported kind; without any file v1 says no and v2 yes."""
    _check_flavor(flavor)
    names = files["filename"]
    if flavor == "v1":
        return F.forall(names, lambda f: language_v1(f).isNotNull()) & (F.size(names) > 0)
    return F.forall(names, lambda f: language_v2(f).isNotNull())


def complete_patches(files: Column) -> Column:
    """Every file has a patch (binary and oversized files have none)."""
    return F.forall(files["patch"], lambda patch: patch.isNotNull())


def fits_size(files: Column, max_chars: int) -> Column:
    """Quarantine rule: the patches together are at most this long; a commit is one row of text."""
    return (
        F.aggregate(
            files["patch"],
            F.lit(0).cast("bigint"),
            lambda total, patch: total + F.coalesce(F.length(patch), F.lit(0)),
        )
        <= max_chars
    )


def content_type(files: Column) -> Column:
    """struct<content_type, main_lang> of a commit; both null when a file is unsupported.

    The main language is the most frequent one, alphabetical on ties.
    """

    def classify(langs: Column) -> Column:
        distinct = F.array_distinct(langs)
        ranked = F.transform(
            distinct,
            lambda lang: F.struct(
                (-F.size(F.filter(langs, lambda x: x == lang))).alias("rank"), lang.alias("lang")
            ),
        )
        kind = F.when(F.size(distinct) > 1, F.lit("Mixed")).otherwise(F.get(langs, F.lit(0)))
        known = (F.size(langs) > 0) & F.forall(langs, lambda x: x.isNotNull())
        return F.struct(
            F.when(known, kind).alias("content_type"),
            F.when(known, F.array_min(ranked)["lang"]).alias("main_lang"),
        )

    return bind(languages(files), classify)


def mixed_content(content_types: Column) -> Column:
    """'PL' above one programming language, else 'NL_ONLY' with any Markdown, else 'NO'."""
    distinct = F.array_distinct(content_types)
    programming = F.size(F.array_remove(distinct, NATURAL_LANGUAGE))
    return (
        F.when(programming > 1, F.lit("PL"))
        .when(F.array_contains(distinct, NATURAL_LANGUAGE), F.lit("NL_ONLY"))
        .otherwise(F.lit("NO"))
    )


def file_count(files: Column) -> Column:
    return F.size(files)
