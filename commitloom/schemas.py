"""Declared schemas of the landed and intermediate tables; nothing is inferred."""

from pyspark.sql import types as T


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_STR, _INT, _BOOL = T.StringType(), T.IntegerType(), T.BooleanType()

API_COMMIT = _struct(
    sha=_STR,
    commit=_struct(author=_struct(name=_STR), committer=_struct(name=_STR), message=_STR),
)

COMMIT_METADATA = _struct(sha=_STR, author=_STR, committer=_STR, message=_STR)

REPO_METADATA = _struct(owner=_STR, name=_STR, commits_metadata=T.ArrayType(COMMIT_METADATA))

ANNOTATED = _struct(
    sha=_STR,
    author=_STR,
    committer=_STR,
    message=_STR,
    subject=_STR,
    subject_length=_INT,
    is_chore=_BOOL,
    is_bot=_BOOL,
    subject_word_count=_INT,
    verb_object_spacy=_BOOL,
    verb_object_stanza=_BOOL,
    fits_requirements=_BOOL,
)

API_FILE = _struct(filename=_STR, previous_filename=_STR, status=_STR, patch=_STR)

RAW_DIFF = _struct(message=_STR, files=T.ArrayType(API_FILE))

# The file contents of the dump stay out of the schema, so JSON parsing skips them.
DRILLED_FILE = _struct(status=_STR, content_type=_STR, patch=_STR, path_before=_STR, path_after=_STR)

DRILLED_COMMIT = _struct(
    repository=_STR,
    author=_STR,
    committer=_STR,
    message=_STR,
    hash=_STR,
    mixed_content=_STR,
    parents=T.ArrayType(_STR),
    files=T.ArrayType(DRILLED_FILE),
)

DRILLED = _struct(commits=T.ArrayType(DRILLED_COMMIT))

PROCESSED = _struct(
    content_type=_STR, main_lang=_STR, message=_STR, sha=_STR, patch=_STR, file_count=_INT
)

# One token of the dependency parse; ``head`` is the 0-based position of the governing token.
PARSE_TOKENS = T.ArrayType(_struct(text=_STR, dep=_STR, tag=_STR, head=_INT))

# One word of a sentence-wise parse; ``id`` and ``head`` are 1-based, 0 is the root's head.
PARSE_SENTENCES = T.ArrayType(T.ArrayType(_struct(id=_INT, deprel=_STR, xpos=_STR, head=_INT)))
