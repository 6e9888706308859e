"""Registered queries: every operator over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as X
from . import schemas
from .config import ExampleConfig, StageConfig, StagePaths
from .functions import arrays as A
from .functions import message as M
from .functions import patch as P
from .functions import verb_object as V
from .functions.bleu import bleu_tokens as tokens_13a
from .functions.hashing import key_hash
from .functions.text import present
from .operators import annotate as ann
from .operators import corpus, evaluation, examples, filters, parsing, vocabulary
from .plans import jobs, landing, work
from .sources import readers, scratch, stages, writers
from .streaming.ingest import ingest_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

VOCAB_SIZE = 5_000
# Message vocabulary runs use short frames so that cutting and refusing both occur.
PAIR_SIZE = 256


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _flat(array: Column, separator: str = " ") -> Column:
    """An array as text, so that results compare on any engine."""
    return F.array_join(array.cast("array<string>"), separator)


# --- messages -------------------------------------------------------------------------


@query
def extract_subject_v1(spark, sf_dir):
    return X.commits(spark, sf_dir).select(
        "sha", M.extract_subject_v1(F.col("message")).alias("subject")
    )


@query
def extract_subject_v1_literal(spark, sf_dir):
    return X.commits(spark, sf_dir).select(
        "sha", M.extract_subject_v1(F.col("message"), literal=True).alias("subject")
    )


@query
def extract_subject_v2(spark, sf_dir):
    return X.commits(spark, sf_dir).select(
        "sha", M.extract_subject_v2(F.col("message")).alias("subject")
    )


@query
def message_lengths(spark, sf_dir):
    """Length and word count over whole messages, not only subjects."""
    message = F.col("message")
    return X.commits(spark, sf_dir).select(
        "sha",
        M.subject_length(message).alias("message_length"),
        M.word_count(message).alias("message_word_count"),
    )


@query
def annotate_rules(spark, sf_dir):
    return ann.annotate_rules(ann.with_subject(X.commits(spark, sf_dir))).select(
        "sha", "subject", "subject_length", "is_chore", "is_bot", "subject_word_count"
    )


@query
def is_bot(spark, sf_dir):
    author = F.col("author")
    return X.commits(spark, sf_dir).select(
        "sha",
        M.is_bot(author).alias("is_bot_v1"),
        M.is_bot(author, ignore_case=False).alias("is_bot_v2"),
    )


@query
def message_prompt(spark, sf_dir):
    message = F.col("message")
    return X.commits(spark, sf_dir).select(
        "sha",
        M.message_prompt(message).alias("prompt"),
        M.message_prompt(message, collapse=True).alias("eval_prompt"),
    )


@query
def source_prompt(spark, sf_dir):
    return _processed(spark, sf_dir).select(
        "sha", M.source_prompt(F.col("main_lang"), F.col("patch")).alias("prompt")
    )


# --- files and patches ----------------------------------------------------------------


def _file_rows(spark, sf_dir) -> DataFrame:
    return X.commit_files(spark, sf_dir).select(
        "sha", F.posexplode("files").alias("file_idx", "file")
    )


def _processed(spark, sf_dir) -> DataFrame:
    return jobs.preprocess(X.commit_files(spark, sf_dir), None, ["owner", "repo", "sha"])


@query
def file_languages(spark, sf_dir):
    name = F.col("file.filename")
    return _file_rows(spark, sf_dir).select(
        "sha",
        "file_idx",
        P.language_v1(name).alias("language_v1"),
        P.language_v2(name).alias("language_v2"),
        P.language_raw(name).alias("language_raw"),
        P.language_raw(name, compat=True).alias("language_raw_compat"),
    )


@query
def path_header_v1(spark, sf_dir):
    return _file_rows(spark, sf_dir).select(
        "sha", "file_idx", _flat(P.path_header_v1(F.col("file")), "\n").alias("header")
    )


@query
def path_header_v2(spark, sf_dir):
    rows = X.drilled_commits(spark, sf_dir).select("hash", F.posexplode("files").alias("file_idx", "file"))
    return rows.select(
        "hash", "file_idx", _flat(P.path_header_v2(F.col("file")), "\n").alias("header")
    )


@query
def tag_patch(spark, sf_dir):
    lines = P.tag_patch(F.col("file.patch"))
    tagged = _file_rows(spark, sf_dir).where(F.col("file.patch").isNotNull())
    return tagged.select("sha", "file_idx", F.posexplode(lines).alias("line_idx", "line"))


@query
def serialize_commit_v1(spark, sf_dir):
    files = F.col("files")
    return (
        X.commit_files(spark, sf_dir)
        .where(P.complete_patches(files))
        .select("sha", P.serialize_commit(files, "v1").alias("patch"))
    )


@query
def serialize_commit_v2(spark, sf_dir):
    return X.drilled_commits(spark, sf_dir).select(
        "hash", P.serialize_commit(F.col("files"), "v2").alias("patch")
    )


@query
def gather_files(spark, sf_dir):
    """Long file rows regrouped per commit, then serialised."""
    rows = _file_rows(spark, sf_dir).select("sha", "file_idx", "file.*")
    files = corpus.gather_files(rows, ("sha",))
    return files.where(P.complete_patches(F.col("files"))).select(
        "sha", P.serialize_commit(F.col("files"), "v1").alias("patch")
    )


def _forks(rows: DataFrame, **changed: Column) -> DataFrame:
    """The rows, and each again with its hash in a fork of the repository that changed some columns."""
    fork = rows.withColumns({"repo": F.concat("repo", F.lit("-fork")), **changed})
    return rows.unionByName(fork)


def _commit_id() -> Column:
    return F.concat_ws("/", "owner", "repo", "sha").alias("id")


@query
def gather_files_forks(spark, sf_dir):
    """Long file rows of repositories and their forks, which share hashes, regrouped per commit."""
    rows = X.commit_files(spark, sf_dir).select("owner", "repo", "sha", F.posexplode("files").alias("file_idx", "file"))
    rows = rows.select("owner", "repo", "sha", "file_idx", "file.*")
    both = _forks(rows, filename=F.concat(F.lit("fork/"), "filename"))
    files = corpus.gather_files(both, ("owner", "repo", "sha"))
    kept = files.where(P.complete_patches(F.col("files")))
    return kept.select(_commit_id(), P.serialize_commit(F.col("files"), "v1").alias("patch"))


def _with_specials(patch: Column) -> Column:
    """Patch text with special tokens strewn in, one of them formed by another's removal."""
    noisy = F.replace(patch, F.lit(" the "), F.lit(" <s> <m<pad>sk> "))
    return F.replace(F.replace(noisy, F.lit(" la "), F.lit(" <mask<s>> ")), F.lit(" und "), F.lit("</s>"))


@query
def scrub_special(spark, sf_dir):
    return _processed(spark, sf_dir).select(
        "sha", P.scrub_special(_with_specials(F.col("patch"))).alias("patch")
    )


@query
def untag(spark, sf_dir):
    return _processed(spark, sf_dir).select("sha", P.untag(F.col("patch")).alias("patch"))


@query
def explode_files(spark, sf_dir):
    return corpus.explode_files(X.commit_files(spark, sf_dir))


@query
def explode_files_compat(spark, sf_dir):
    return corpus.explode_files(X.commit_files(spark, sf_dir), compat=True)


@query
def repo_key(spark, sf_dir):
    return X.commits(spark, sf_dir).select(
        "sha", P.repo_key(F.col("owner"), F.col("repo")).alias("repo_key")
    )


# --- filters --------------------------------------------------------------------------


def _flagged(spark, sf_dir) -> DataFrame:
    """Commits with rules and both verb-object flags of the given parses."""
    return ann.annotate_rules(X.parsed_commits(spark, sf_dir)).withColumns(
        {
            "verb_object_spacy": V.verb_object_spacy(F.col("tokens")),
            "verb_object_stanza": V.verb_object_stanza(F.col("sentences")),
        }
    )


def _annotated(spark, sf_dir) -> DataFrame:
    rows = _flagged(spark, sf_dir).withColumn("fits_requirements", ann.requirements_mask())
    return rows.select("owner", "repo", *schemas.ANNOTATED.fieldNames(), "doc_id")


@query
def requirements_mask(spark, sf_dir):
    return _flagged(spark, sf_dir).select(
        "sha",
        ann.requirements_mask().alias("fits_either"),
        ann.requirements_mask("compat").alias("fits_compat"),
    )


@query
def commit_quality_filter(spark, sf_dir):
    rows = _flagged(spark, sf_dir).withColumn("subject", M.extract_subject_v2(F.col("message")))
    return ann.commit_quality_filter(rows).select("sha", "subject")


@query
def all_files_supported_v1(spark, sf_dir):
    return filters.all_files_supported(_some_without_files(spark, sf_dir), "v1").select("sha")


@query
def all_files_supported_v2(spark, sf_dir):
    return filters.all_files_supported(_some_without_files(spark, sf_dir), "v2").select("sha")


def _some_without_files(spark, sf_dir) -> DataFrame:
    files = F.filter("files", lambda f: F.col("doc_id") % 12 != 0)
    return X.commit_files(spark, sf_dir).withColumn("files", files)


@query
def complete_patches(spark, sf_dir):
    return filters.complete_patches(X.commit_files(spark, sf_dir)).select("sha")


def _gappy(spark, sf_dir) -> DataFrame:
    """Commits with some authors and some subjects missing."""
    n = F.col("doc_id")
    return ann.with_subject(X.commits(spark, sf_dir)).select(
        "sha",
        F.when(n % 5 != 1, F.col("author")).alias("author"),
        "committer",
        F.when(n % 6 != 2, F.col("subject")).alias("subject"),
    )


@query
def drop_incomplete_rows(spark, sf_dir):
    return filters.drop_incomplete_rows(_gappy(spark, sf_dir))


@query
def drop_incomplete_columns(spark, sf_dir):
    return filters.drop_incomplete_columns(_gappy(spark, sf_dir))


@query
def single_file(spark, sf_dir):
    return filters.single_file(_processed(spark, sf_dir)).select("sha", "file_count")


@query
def unmixed(spark, sf_dir):
    return filters.unmixed(_processed(spark, sf_dir)).select("sha", "content_type")


@query
def for_language(spark, sf_dir):
    return filters.for_language(_processed(spark, sf_dir), "Python").select("sha", "main_lang")


@query
def drop_null_messages(spark, sf_dir):
    rows = _gappy(spark, sf_dir).select("sha", F.col("subject").alias("message"))
    return filters.drop_null_messages(rows)


@query
def no_merges(spark, sf_dir):
    parents = F.array_repeat(F.col("sha"), (F.col("doc_id") % 4).cast("int"))
    rows = X.commits(spark, sf_dir).withColumn("parents", parents)
    return filters.no_merges(rows).select("sha", F.size("parents").alias("n_parents"))


@query
def reapply_rules(spark, sf_dir):
    """Rules renewed over stored rows whose rule columns are stale and partly missing."""
    stale = _annotated(spark, sf_dir).withColumns(
        {
            "is_chore": F.lit(False),
            "subject_length": F.lit(0),
            "author": F.when(F.col("doc_id") % 19 != 3, F.col("author")),
        }
    )
    return ann.reapply_rules(stale).select(
        "sha", "subject_length", "is_chore", "is_bot", "subject_word_count", "fits_requirements"
    )


# --- verb-object rules ----------------------------------------------------------------


@query
def verb_object_spacy(spark, sf_dir):
    return X.parsed_commits(spark, sf_dir).select(
        "sha", V.verb_object_spacy(F.col("tokens")).alias("verb_object")
    )


@query
def verb_object_stanza(spark, sf_dir):
    return X.parsed_commits(spark, sf_dir).select(
        "sha", V.verb_object_stanza(F.col("sentences")).alias("verb_object")
    )


def _stand_in_parsers():
    """Two tiny deterministic parsers; local functions, so that they travel to the workers."""

    def token_parser():
        """The third word is the object; a first word of 5n letters is no verb."""

        def parse(subject: str) -> list[dict]:
            return [
                {
                    "text": word,
                    "dep": "ROOT" if i == 0 else "dobj" if i == 2 else "det",
                    "tag": "NN" if i or len(word) % 5 == 0 else "VB",
                    "head": 2 if i == 1 else 0,
                }
                for i, word in enumerate(subject.split())
            ]

        return parse

    def sentence_parser():
        """The last word is the object; a first word of odd length is no verb."""

        def parse(subject: str) -> list[list[dict]]:
            parts = subject.split()
            last = len(parts) - 1
            return [
                [
                    {
                        "id": i + 1,
                        "deprel": "root" if i == 0 else "obj" if i == last else "det",
                        "xpos": "NN" if i or len(word) % 2 else "VB",
                        "head": last + 1 if 0 < i < last else int(i > 0),
                    }
                    for i, word in enumerate(parts)
                ]
            ]

        return parse

    return token_parser, sentence_parser


token_parser, sentence_parser = _stand_in_parsers()


@query
def with_verb_object(spark, sf_dir):
    """Both parsers on every row."""
    rows = ann.annotate_rules(ann.with_subject(X.commits(spark, sf_dir)))
    parsed = parsing.with_verb_object(
        rows, token_parser, sentence_parser, ann.cheap_rules(), full=True
    )
    return parsed.select("sha", "verb_object_spacy", "verb_object_stanza")


# --- joins and work lists -------------------------------------------------------------


@query
def passing_only(spark, sf_dir):
    diffs = X.commit_files(spark, sf_dir).select("owner", "repo", "sha", "message")
    return filters.passing_only(diffs, _annotated(spark, sf_dir), ["owner", "repo", "sha"])


@query
def pending_units(spark, sf_dir):
    """Repositories without any processed commit yet."""
    units = X.commits(spark, sf_dir).select("owner", "repo").distinct()
    done = _processed(spark, sf_dir).where("file_count = 3").select("owner", "repo").distinct()
    return work.pending_units(units, done, ["owner", "repo"])


@query
def diff_fetch_plan(spark, sf_dir):
    landed = filters.complete_patches(X.commit_files(spark, sf_dir))
    return work.diff_fetch_plan(_annotated(spark, sf_dir), landed, ["owner", "repo", "sha"])


def _repo_counts(spark, sf_dir) -> DataFrame:
    """Repositories with a commit count of their texts' words."""
    counted = X.commits(spark, sf_dir).groupBy("owner", "repo").agg(
        F.sum(M.word_count(F.col("message"))).alias("n")
    )
    count = F.when(F.col("n") % 5 == 0, F.lit(-1)).otherwise(F.col("n")).cast("bigint")
    return counted.select("owner", "repo", count.alias("commit_count"))


@query
def page_plan_compat(spark, sf_dir):
    return work.page_plan(_repo_counts(spark, sf_dir))


@query
def page_plan_full(spark, sf_dir):
    return work.page_plan(_repo_counts(spark, sf_dir), mode="full")


@query
def last_page(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    link = F.concat(
        F.lit("<"), "url", F.lit('&page=2>; rel="next", <'), "url", F.lit("&page="),
        F.col("page_id").cast("string"), F.lit('>; rel="last"'),
    )
    header = F.when(F.col("page_id") % 9 != 4, link)
    numbered = pages.select("page_id", work.last_page(header).alias("last_page"))
    return numbered.withColumn("last_page", F.coalesce("last_page", F.lit(-1)))


@query
def quarantine(spark, sf_dir):
    """Commits kept or set aside, with the first rule broken."""
    rules = {
        "patch": P.complete_patches(F.col("files")),
        "language": P.all_files_supported(F.col("files")),
        "subject": F.length(M.extract_subject_v1(F.col("message"))) <= 50,
    }
    good, bad = work.quarantine(X.commit_files(spark, sf_dir), rules)
    kept = good.select("sha", F.lit("").alias("reason"))
    return kept.unionByName(bad.select("sha", "reason"))


# --- aggregations ---------------------------------------------------------------------


@query
def content_type(spark, sf_dir):
    content = P.content_type(F.col("files"))
    return X.commit_files(spark, sf_dir).select("sha", content.alias("c")).select("sha", "c.*")


@query
def mixed_content(spark, sf_dir):
    return X.drilled_commits(spark, sf_dir).select("hash", "mixed_content")


@query
def file_count(spark, sf_dir):
    return X.commit_files(spark, sf_dir).select("sha", P.file_count(F.col("files")).alias("file_count"))


@query
def funnel(spark, sf_dir):
    landed = filters.complete_patches(X.commit_files(spark, sf_dir))
    flags = corpus.funnel_flags(
        X.commits(spark, sf_dir), _annotated(spark, sf_dir), landed, _processed(spark, sf_dir)
    )
    named = {k: F.coalesce(k, F.lit("*")) for k in ("owner", "repo")}
    return corpus.funnel(flags).withColumns(named)


@query
def bleu_tokens(spark, sf_dir):
    pairs = X.eval_pairs(spark, sf_dir)
    text = F.concat("prediction", F.lit(" &amp; 3.5,x-1 (a_b) <skipped>-9 end.\n&quot;q&quot;"))
    return pairs.select("example_id", _flat(tokens_13a(text)).alias("tokens"))


@query
def corpus_bleu(spark, sf_dir):
    return evaluation.corpus_bleu(X.eval_pairs(spark, sf_dir))


@query
def corpus_bleu_by_language(spark, sf_dir):
    return evaluation.corpus_bleu(
        X.eval_pairs(spark, sf_dir), ["main_lang"], smooth=False, plain=True
    )


@query
def bleu_report(spark, sf_dir):
    return evaluation.bleu_report(X.eval_pairs(spark, sf_dir))


@query
def corpus_bleu_nulls(spark, sf_dir):
    """Some predictions and references are missing."""
    pairs, n = X.eval_pairs(spark, sf_dir), F.col("example_id")
    gaps = {"prediction": F.when(n % 7 != 2, F.col("prediction")), "reference": F.when(n % 9 != 4, F.col("reference"))}
    return evaluation.corpus_bleu(pairs.withColumns(gaps))


def _predicted(spark, sf_dir) -> DataFrame:
    """Token labels of whole texts and predictions that miss some of them."""
    n = F.col("example_id")
    text = F.split("reference", " ")
    labels = F.transform(
        text, lambda w, i: F.when((n + i) % 4 == 0, F.lit(-100)).otherwise(F.length(w))
    )
    predictions = F.transform(
        text, lambda w, i: F.length(w) + F.when((n + i) % 3 == 0, F.lit(1)).otherwise(F.lit(0))
    )
    return X.eval_pairs(spark, sf_dir).select(
        "example_id", "model", "main_lang", labels.alias("labels"), predictions.alias("predictions")
    )


@query
def masked_accuracy(spark, sf_dir):
    totals = evaluation.masked_accuracy(_predicted(spark, sf_dir), ["main_lang"])
    return totals.withColumn("accuracy", F.round("accuracy", 6))


@query
def masked_accuracy_gaps(spark, sf_dir):
    """Some rows have no predictions, some have three too few."""
    n, given = F.col("example_id"), F.col("predictions")
    short = F.slice(given, F.lit(1), F.greatest(F.size(given) - 3, F.lit(0)))
    gaps = F.when(n % 5 == 2, short).when(n % 5 != 1, given)
    totals = evaluation.masked_accuracy(_predicted(spark, sf_dir).withColumn("predictions", gaps), ["main_lang"])
    return totals.withColumn("accuracy", F.round("accuracy", 6))


@query
def accuracy_report(spark, sf_dir):
    report = evaluation.accuracy_report(_predicted(spark, sf_dir))
    scores = [evaluation.OVERALL, *evaluation.REPORT_LANGUAGES]
    return report.withColumns({c: F.round(c, 6) for c in scores})


# --- union, order, split, samples -----------------------------------------------------


@query
def union_repos(spark, sf_dir):
    rows = _annotated(spark, sf_dir).drop("doc_id")
    text = rows.withColumn("subject_length", F.col("subject_length").cast("string"))
    return corpus.union_repos([text.where("owner = 'en'"), text.where("owner <> 'en'")]).select(
        "owner", "repo", "sha", "subject_length", "fits_requirements"
    )


@query
def shuffle(spark, sf_dir):
    rows = corpus.shuffle(X.commits(spark, sf_dir), "sha", "7")
    return rows.select("sha", key_hash(F.col("sha"), "7").alias("order_key"))


@query
def split(spark, sf_dir):
    return corpus.split(X.commits(spark, sf_dir), "sha", "7").select("sha", "split")


@query
def debug_head(spark, sf_dir):
    return corpus.debug_head(corpus.split(X.commits(spark, sf_dir))).select("sha", "split")


@query
def sample_rows(spark, sf_dir):
    return corpus.sample_rows(X.commits(spark, sf_dir), 100, seed="3").select("sha", "message")


@query
def sample_with_replacement(spark, sf_dir):
    return corpus.sample_with_replacement(X.commits(spark, sf_dir), 1_000, seed="3").select("draw", "sha", "message")


# --- training arrays ------------------------------------------------------------------


def _vocab(spark, sf_dir) -> DataFrame:
    rows = _processed(spark, sf_dir)
    return scratch.stored(vocabulary.build_vocab(rows, ["patch", "message"], VOCAB_SIZE))


def _encoded(spark, sf_dir, **options) -> DataFrame:
    rows = _processed(spark, sf_dir).select(
        "sha", "patch", M.message_prompt(F.col("message")).alias("prompt")
    )
    vocab = _vocab(spark, sf_dir)
    return vocabulary.encode(rows, ["patch", "prompt"], vocab, "sha", **options)


@query
def build_vocab(spark, sf_dir):
    rows = _processed(spark, sf_dir)
    return vocabulary.build_vocab(rows, ["patch", "message"], VOCAB_SIZE)


def _ids(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "sha", _flat(F.col("patch_ids")).alias("patch_ids"), _flat(F.col("prompt_ids")).alias("prompt_ids")
    )


@query
def encode(spark, sf_dir):
    return _ids(_encoded(spark, sf_dir))


@query
def encode_by_join(spark, sf_dir):
    """A vocabulary beyond what is looked up inside the row: the heaviest tokens there, the others by a join."""
    return _ids(_encoded(spark, sf_dir, inline=VOCAB_SIZE // 10))


@query
def encode_forks(spark, sf_dir):
    """One hash in two repositories, with two texts."""
    both = _forks(_processed(spark, sf_dir), message=F.concat("message", F.lit(" again")))
    rows = both.select("owner", "repo", "sha", "patch", M.message_prompt(F.col("message")).alias("prompt"))
    encoded = vocabulary.encode(rows, ["patch", "prompt"], _vocab(spark, sf_dir), ["owner", "repo", "sha"])
    ids = [_flat(F.col(c)).alias(c) for c in ("patch_ids", "prompt_ids")]
    return encoded.select(_commit_id(), *ids)


def _hash_ids(text: Column) -> Column:
    """Word ids by word length, for packing without a vocabulary; 2 and 1 occur in them."""
    return F.transform(F.split(text, " "), lambda w: F.length(w) + 5)


def _id_pairs(spark, sf_dir) -> DataFrame:
    """Whole texts as patch ids, their lines as message ids."""
    message = F.transform(F.split("text", "\n"), lambda line: F.length(line) + 5)
    return X.texts(spark, sf_dir).select(
        "doc_id", _hash_ids(F.col("text")).alias("a"), message.alias("b")
    )


def _packed(spark, sf_dir) -> DataFrame:
    packed = A.pack_pair(F.col("a"), F.col("b"), PAIR_SIZE)
    return _id_pairs(spark, sf_dir).select("doc_id", packed.alias("x")).select("doc_id", "x.*")


@query
def pack_pair(spark, sf_dir):
    return _packed(spark, sf_dir).select(
        "doc_id",
        *[
            F.coalesce(_flat(F.col(c)), F.lit("quarantined")).alias(c)
            for c in ("input_ids", "attention_mask", "special_tokens_mask")
        ],
    )


def _labelled(spark, sf_dir) -> DataFrame:
    packed = A.pack_pair(F.col("a"), F.col("b"), PAIR_SIZE)
    rows = _id_pairs(spark, sf_dir).select("doc_id", present(packed))
    return rows.withColumn("span", A.message_span(F.col("input_ids"))).withColumn(
        "y", A.message_labels(F.col("input_ids"), F.col("special_tokens_mask"), F.col("span"))
    )


@query
def message_labels(spark, sf_dir):
    return _labelled(spark, sf_dir).select(
        "doc_id",
        _flat(F.col("y.labels")).alias("labels"),
        _flat(F.col("y.special_tokens_mask")).alias("special_tokens_mask"),
    )


@query
def pack_seq2seq(spark, sf_dir):
    packed = A.pack_seq2seq(F.col("a"), F.col("b"), PAIR_SIZE, 24)
    rows = _id_pairs(spark, sf_dir).select("doc_id", packed.alias("x")).select("doc_id", "x.*")
    return rows.select(
        "doc_id",
        _flat(F.col("input_ids")).alias("input_ids"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("attended"),
        _flat(F.col("labels")).alias("labels"),
        _flat(A.restore_padding(F.col("labels"))).alias("restored"),
    )


@query
def mlm_mask(spark, sf_dir):
    noise = A.mlm_mask(
        F.col("input_ids"), F.col("y.special_tokens_mask"), F.col("doc_id"), 500, 0.5, "5", 2
    )
    rows = _labelled(spark, sf_dir).select("doc_id", noise.alias("z"))
    return rows.select(
        "doc_id", _flat(F.col("z.input_ids")).alias("input_ids"), _flat(F.col("z.labels")).alias("labels")
    )


@query
def mask_one(spark, sf_dir):
    masked = examples.masked_examples(_labelled(spark, sf_dir), "doc_id", "5")
    return masked.withColumn("input_ids", _flat(F.col("input_ids")))


@query
def mask_one_word(spark, sf_dir):
    return X.commits(spark, sf_dir).select(
        "sha", A.mask_one_word(F.col("message"), F.col("sha"), "5").alias("message")
    )


@query
def argmax_ids(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return table.select("vec_id", A.argmax_ids(F.col("embedding")).alias("best"))


@query
def subsequence_positions(spark, sf_dir):
    """Where the first two words' lengths recur in a text's word lengths."""
    rows = X.texts(spark, sf_dir).select("doc_id", _hash_ids(F.col("text")).alias("ids"))
    wanted = rows.withColumn("wanted", F.slice("ids", 1, 2))
    found = A.subsequence_positions(F.col("ids"), F.col("wanted"))
    return wanted.select("doc_id", _flat(found).alias("positions"))


def _published(spark, sf_dir) -> DataFrame:
    return corpus.split(_processed(spark, sf_dir))


@query
def prepare_mlm(spark, sf_dir):
    config = ExampleConfig(max_input_size=PAIR_SIZE)
    prepared = examples.mlm_examples(_published(spark, sf_dir), _vocab(spark, sf_dir), config)
    columns = ("input_ids", "attention_mask", "special_tokens_mask", "labels")
    return prepared.select(
        "sha", *[F.coalesce(_flat(F.col(c)), F.lit("quarantined")).alias(c) for c in columns]
    )


@query
def prepare_seq2seq(spark, sf_dir):
    config = ExampleConfig(PAIR_SIZE, 16, allow_multi_file_commits=True, allow_mixed_files=True)
    prepared = examples.seq2seq_examples(_published(spark, sf_dir), _vocab(spark, sf_dir), config)
    columns = ("input_ids", "attention_mask", "labels")
    return prepared.select("sha", *[_flat(F.col(c)).alias(c) for c in columns])


@query
def prepare_debug(spark, sf_dir):
    config = ExampleConfig(debug=True, debug_rows=5)
    return examples.select_examples(_published(spark, sf_dir), config).select("sha", "split")


@query
def prepare_eval(spark, sf_dir):
    rows = examples.prepare_eval(_processed(spark, sf_dir))
    return rows.select("sha", "patch", "message", "main_lang")


@query
def prepare_eval_compat(spark, sf_dir):
    rows = examples.prepare_eval(_processed(spark, sf_dir), compat=True, lang="Go")
    return rows.select("sha", "patch", "message", "main_lang")


# --- sources, sinks and jobs ----------------------------------------------------------


@query
def repo_list(spark, sf_dir):
    """Repository lines made of page URLs, some commented out, some without a slash."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    n, url = F.col("page_id"), F.col("url")
    line = (
        F.when(n % 10 == 0, F.concat(F.lit("#"), url))
        .when(n % 10 == 1, F.concat(url, F.lit("/")))
        .when(n % 10 == 2, F.replace(url, F.lit("/"), F.lit("")))
        .otherwise(url)
    )
    rows = readers.parse_repo_lines(pages.select(line.alias("value")))
    return rows.withColumn("owner", F.coalesce("owner", F.lit("quarantined")))


@query
def stage_csv_round_trip(spark, sf_dir):
    """Processed rows through stage CSV files, patches with line breaks and quotes included."""
    path = scratch.new_folder(spark)
    quoted = F.concat(F.lit('say "'), "message", F.lit('"'))
    rows = _processed(spark, sf_dir).select(*schemas.PROCESSED.fieldNames())
    rows.withColumn("message", quoted).write.csv(path, header=True, quote='"', escape='"')
    return readers.read_stage_csv(spark, path, schemas.PROCESSED)


@query
def stage_round_trip(spark, sf_dir):
    """Annotated rows written per repository and read back."""
    path = scratch.new_folder(spark)
    rows = _annotated(spark, sf_dir).select("owner", "repo", "sha", "subject", "fits_requirements")
    writers.write_stage(rows, path, ["owner", "repo"])
    return readers.read_stage(spark, path)


@query
def dataset_round_trip(spark, sf_dir):
    """Rows published by split, in random order; each split read back."""
    path = scratch.new_folder(spark)
    writers.export_splits(_published(spark, sf_dir), path, seed="7")
    parts = [readers.read_dataset(spark, path, name) for name in corpus.SPLITS]
    return reduce(DataFrame.union, parts).select("sha", "main_lang", "patch", "split")


@query
def report_round_trip(spark, sf_dir):
    path = scratch.new_folder(spark)
    writers.write_report(bleu_report(spark, sf_dir), path)
    columns = ["model", "input", evaluation.OVERALL, *evaluation.REPORT_LANGUAGES]
    kinds = ["string", "string"] + ["double"] * (len(columns) - 2)
    schema = ", ".join(f"{c} {k}" for c, k in zip(columns, kinds))
    return spark.read.csv(path, header=True, schema=schema)


@query
def annotate_job(spark, sf_dir):
    rows = X.commits(spark, sf_dir).drop("doc_id", "committer").withColumn("committer", F.col("author"))
    annotated = jobs.annotate(rows, token_parser, sentence_parser)
    return annotated.select(
        "sha", "subject", "subject_length", "is_chore", "is_bot", "subject_word_count", "fits_requirements"
    )


@query
def preprocess_job(spark, sf_dir):
    return jobs.preprocess(
        X.commit_files(spark, sf_dir), _annotated(spark, sf_dir), ["owner", "repo", "sha"]
    )


@query
def drill_job(spark, sf_dir):
    return jobs.drill(X.parsed_drilled_commits(spark, sf_dir))


@query
def drill_job_with_parsers(spark, sf_dir):
    return jobs.drill(X.drilled_commits(spark, sf_dir), token_parser, sentence_parser).select(
        "hash", "mixed_content"
    )


@query
def drill_job_merges(spark, sf_dir):
    """History dumps that name the parents of some commits."""
    n = F.col("doc_id")
    parents = F.when(n % 5 != 0, F.array_repeat(F.col("hash"), (n % 4).cast("int")))
    return jobs.drill(X.parsed_drilled_commits(spark, sf_dir).withColumn("parents", parents))


@query
def publish_raw(spark, sf_dir):
    """File rows of fitting commits, with every third hash listed twice in the metadata."""
    annotated = _annotated(spark, sf_dir)
    twice = annotated.unionByName(annotated.where("doc_id % 3 = 0"))
    key = P.repo_key(F.col("owner"), F.col("repo"))
    diffs = X.commit_files(spark, sf_dir).select(key.alias("repo_key"), "sha", "message", "files")
    return jobs.raw_rows(diffs, twice)


# --- jobs over files ------------------------------------------------------------------

FILE_PART = 512  # neighbouring documents that one metadata file may hold, where the result has a row per file
API_PAGE = 100  # commits in an answer of the API, at most
WIDE_PART = 8192  # and where it has none


def _part(single: Column) -> Column:
    """The part of a repository that a commit's file holds: narrow where ``single`` files are counted, else wide."""
    n = F.col("doc_id")
    return F.when(single, F.floor(n / FILE_PART)).otherwise(F.floor(n / WIDE_PART))


def _turn() -> Column:
    """The one of two runs, 0 or 1, in which a commit lands."""
    return F.floor(F.col("doc_id") / FILE_PART) % 2


def _metadata_rows(spark, sf_dir, broken: Column | None = None) -> DataFrame:
    broken = F.lit(False) if broken is None else broken
    return X.commits(spark, sf_dir).withColumns({"part": _part(broken), "broken": broken})


def _drilled_rows(spark, sf_dir) -> DataFrame:
    """Drilled commits, those of repositories that end in 7 unreadable."""
    broken = F.col("repository").endswith("7")
    return X.drilled_commits(spark, sf_dir).withColumns({"part": _part(broken), "broken": broken})


@query
def read_checked(spark, sf_dir):
    """Metadata files, those of every repository that ends in 7 unreadable: good rows, and a row per lost file."""
    path = scratch.new_folder(spark)
    X.write_metadata(_metadata_rows(spark, sf_dir, F.col("repo").endswith("7")), path)
    good, bad = work.quarantine(readers.read_repo_metadata(spark, path), {"unreadable": readers.is_readable()})
    lost = bad.select(F.lit("").alias("sha"), F.lit("").alias("message"), "reason")
    return good.select("sha", "message", F.lit("").alias("reason")).unionByName(lost)


@query
def stage_second_run(spark, sf_dir):
    """Two runs of the annotation job, the second over everything again and a repository without commits."""
    source, out = scratch.new_folder(spark), scratch.new_folder(spark)
    X.write_metadata(_metadata_rows(spark, sf_dir), source)
    jobs.annotate_job(spark, source, out, token_parser, sentence_parser)
    empty = spark.range(1).select(F.lit("none").alias("owner"), F.lit("empty").alias("name"), F.array().alias("commits_metadata"))
    empty.write.mode("append").json(source)
    jobs.annotate_job(spark, source, out, token_parser, sentence_parser)
    done = readers.read_stage(spark, f"{out}-done").select("owner", "repo", F.lit("").alias("sha"), F.lit("done").alias("state"))
    return readers.read_stage(spark, out).select("owner", "repo", "sha", F.lit("stored").alias("state")).unionByName(done)


@query
def rerun_rules(spark, sf_dir):
    """An overwriting run in which every repository that ends in 1 has lost all its rows."""
    source, again, out = (scratch.new_folder(spark) for _ in range(3))
    rows = _metadata_rows(spark, sf_dir)
    X.write_metadata(rows, source)
    jobs.annotate_job(spark, source, out, token_parser, sentence_parser)
    bots = F.when(~F.col("repo").endswith("1"), F.col("author"))
    X.write_metadata(rows.withColumn("author", bots), again)
    jobs.annotate_job(spark, again, out, token_parser, sentence_parser, StageConfig(overwrite_existing=True))
    return readers.read_stage(spark, out).select("owner", "repo", "sha", "subject")


@query
def read_top_repos(spark, sf_dir):
    """A Latin-1 table of repositories, a line per document."""
    path = scratch.new_folder(spark)
    name = F.concat("lang", F.lit("/caf\u00e9-"), F.col("doc_id").cast("string"))
    language = F.when(F.col("doc_id") % 3 == 0, "JavaScript").otherwise(F.upper("lang"))
    rows = X.documents(spark, sf_dir).select(
        name.alias("name"), F.lit(7).alias("stars"), F.col("source").alias("defaultBranch"), language.alias("mainLanguage")
    )
    rows.write.csv(path, header=True, encoding="ISO-8859-1")
    return readers.read_top_repos(spark, path)


@query
def read_api_commits(spark, sf_dir):
    """Commits as the API nests and pages them, a file for each page of neighbouring documents."""
    path = scratch.new_folder(spark)
    person = lambda c: F.struct(F.col(c).alias("name"), F.lit("x").alias("email"))
    commit = F.struct(person("author").alias("author"), person("committer").alias("committer"), "message")
    X.write_pages(X.commits(spark, sf_dir).withColumn("commit", commit), F.floor(F.col("doc_id") / API_PAGE), path)
    return readers.read_api_commits(spark, path, "*.txt").select("sha", "author", "committer", "message")


@query
def read_raw_diffs(spark, sf_dir):
    """Diff files, every ninth unreadable."""
    path = scratch.new_folder(spark)
    key = P.repo_key(F.col("owner"), F.col("repo"))
    X.write_diffs(X.commit_files(spark, sf_dir).withColumns({"repo_key": key, "broken": F.col("doc_id") % 9 == 4}), path)
    rows = readers.read_raw_diffs(spark, path)
    names = F.concat_ws(" ", F.col("files")["filename"])
    text = F.array_join(F.col("files")["patch"], "\n")
    lost = F.col(readers.CORRUPT).isNotNull()
    return rows.select("repo_key", *[F.when(~lost, c).alias(n) for c, n in ((F.col("message"), "message"), (names, "names"), (text, "patches"))]).na.fill("")


@query
def read_drilled(spark, sf_dir):
    """History dumps, those of repositories that end in 7 unreadable."""
    path = scratch.new_folder(spark)
    X.write_dumps(_drilled_rows(spark, sf_dir), path)
    rows = readers.read_drilled(spark, path)
    patches = F.array_join(F.col("files")["patch"], "\n").alias("patches")
    lost = F.when(F.col(readers.CORRUPT).isNotNull(), "unreadable").otherwise("").alias("reason")
    return rows.select("repository", "hash", "mixed_content", "message", patches, lost).na.fill("")


@query
def read_drilled_ranges(spark, sf_dir):
    """History dumps of a repository each, read in ranges of bytes."""
    path = scratch.new_folder(spark)
    whole = {"part": F.lit(0), "broken": F.lit(False)}
    X.write_dumps(X.drilled_commits(spark, sf_dir).withColumns(whole), path)
    rows = readers.read_drilled_ranges(spark, path)
    patches = F.array_join(F.col("files")["patch"], "\n").alias("patches")
    return rows.where(readers.is_readable()).select("repository", "hash", "mixed_content", "message", patches)


@query
def run_stages(spark, sf_dir):
    """All stages from files by one configuration: annotate, preprocess, publish; then the rules again in place."""
    paths = StagePaths(*(scratch.new_folder(spark) for _ in range(5)))
    key = P.repo_key(F.col("owner"), F.col("repo"))
    X.write_diffs(X.commit_files(spark, sf_dir).withColumns({"repo_key": key, "broken": F.lit(False)}), paths.raw_diffs)
    X.write_metadata(_told(readers.read_raw_diffs(spark, paths.raw_diffs)), paths.metadata)
    first = StageConfig(annotate_metadata=True, preprocess_diffs=True)
    jobs.run_stages(spark, first, paths, token_parser, sentence_parser)
    again = StageConfig(rerun_rule_filters=True, overwrite_existing=True, publish_dataset=True, publish_metadata=True)
    jobs.run_stages(spark, again, paths)
    rows = readers.read_dataset(spark, f"{paths.published}/processed-diffs")
    known = spark.read.parquet(f"{paths.published}/analysed-metadata")
    columns = ("content_type", "main_lang", "message", "patch", "file_count")
    return rows.select(*columns).union(known.where("fits_requirements").select(F.lit("known"), "owner", "subject", F.lit(""), "subject_length"))


def _told(diffs: DataFrame) -> DataFrame:
    """Metadata of landed diffs, keyed by their files' names."""
    dev = F.lit("dev")
    return diffs.select(
        F.substring_index("repo_key", "-", 1).alias("owner"), F.expr("substring(repo_key, instr(repo_key, '-') + 1)").alias("repo"),
        "sha", dev.alias("author"), dev.alias("committer"), "message",
        F.pmod(F.xxhash64("sha"), F.lit(16)).alias("part"), F.lit(False).alias("broken"),
    )


@query
def ledger_runs(spark, sf_dir):
    """Metadata landed by file in three runs: first without the repositories that end in 3 and with those in 7 unreadable; then
    these added and those repaired under their names; then nothing changed. Rows with their run, a row per file
    of the ledger, and per file rejected once."""
    source, bad, fixed, out = (scratch.new_folder(spark) for _ in range(4))
    rows = X.commits(spark, sf_dir).withColumns({"part": _part(F.lit(True)), "broken": F.col("repo").endswith("7")})
    X.write_metadata(rows.where("NOT broken AND NOT endswith(repo, '3')"), source, small=True)
    X.write_metadata(rows.where("broken"), bad, small=True)
    broken = X.move_files(spark, bad, source)
    landing.land(spark, landing.METADATA, source, out)
    X.write_metadata(rows.where("broken").withColumn("broken", F.lit(False)), fixed, small=True)
    X.move_files(spark, fixed, source, broken)
    X.write_metadata(rows.where("endswith(repo, '3')"), source, small=True)
    for _ in range(2):
        landing.land(spark, landing.METADATA, source, out)
    number = F.substring(stages.RUN, 2, 10).cast("int")
    none = F.lit("")
    parts = [
        stages.read(spark, out).select("owner", "repo", "sha", F.lit("row").alias("state"), number.alias("run")),
        stages.read(spark, out, stages.LEDGER).select(none, none, none, "outcome", number),
        stages.read(spark, out, stages.REJECTED, live=False).select(none, none, none, F.concat(F.lit("was "), "reason"), number),
        stages.read(spark, out, stages.REJECTED).select(none, none, none, "reason", number),
    ]
    return reduce(DataFrame.union, parts)


@query
def preprocess_files(spark, sf_dir):
    """Diffs landed in two runs, every ninth unreadable, their metadata in two others, and the processed rows that follow
    them: part of the diffs are landed before they are known to fit."""
    diffs, meta, landed, known, annotated, out = (scratch.new_folder(spark) for _ in range(6))
    key = P.repo_key(F.col("owner"), F.col("repo"))
    rows = X.commit_files(spark, sf_dir).withColumns({"repo_key": key, "broken": F.col("doc_id") % 9 == 4})
    late = F.length("message") % 3 == 0
    for turn in range(2):
        X.write_diffs(rows.where((F.col("doc_id") % 4 == 1) == F.lit(turn == 1)), diffs)
        landing.land(spark, landing.DIFFS, diffs, landed)
        names = stages.manifest(spark, landed).names()
        told = stages.read(spark, landed)
        told = told.where(~late) if turn == 0 else told.where((F.col(stages.RUN) == names[1]) | late)
        X.write_metadata(_told(told), meta)
        landing.land(spark, landing.METADATA, meta, known)
        landing.annotate_landed(spark, known, annotated, token_parser, sentence_parser)
        landing.preprocess_landed(spark, landed, annotated, out)
    lost = stages.read(spark, landed, stages.REJECTED).select(*[F.lit("")] * 4, F.lit(0), "reason")
    done = stages.read(spark, out).select("content_type", "main_lang", "message", "patch", "file_count", F.lit("").alias("reason"))
    return done.union(lost)


@query
def drill_files(spark, sf_dir):
    """History dumps landed in two runs, those of repositories that end in 7 unreadable, and the rows that follow them."""
    source, landed, out = (scratch.new_folder(spark) for _ in range(3))
    rows = _drilled_rows(spark, sf_dir)
    for turn in range(2):
        X.write_dumps(rows.where((_turn() == 1) == F.lit(turn == 1)), source)
        landing.land(spark, landing.DUMPS, source, landed)
        landing.drill_landed(spark, landed, out, token_parser, sentence_parser)
    columns = ("repository", "mixed_content", "message", "hash", "patch")
    lost = stages.read(spark, landed, stages.REJECTED).select(*[F.lit("")] * 5, "reason")
    return stages.read(spark, out).select(*columns, F.lit("").alias("reason")).union(lost)


@query
def publish_files(spark, sf_dir):
    """The three published tables made of bucketed stages, one of which still has commits that do not fit."""
    annotated, landed, processed, out = (scratch.new_folder(spark) for _ in range(4))
    key = P.repo_key(F.col("owner"), F.col("repo")).alias("repo_key")
    notes = _annotated(spark, sf_dir).drop("doc_id")
    diffs = X.commit_files(spark, sf_dir).select(key, "sha", "message", "files")
    rows = jobs.preprocess(X.commit_files(spark, sf_dir).withColumn("repo_key", key), None, ["repo_key", "sha"])
    for path, table in ((annotated, notes.select(key, "*")), (landed, diffs), (processed, rows)):
        run = stages.Run(spark, path)
        run.write(stages.ROWS, table.withColumn(stages.FILE, F.lit("")), landing.KEYS)
        run.commit()
    landing.publish_landed(spark, annotated, landed, processed, out, "7")
    none = F.lit("")
    parts = [
        stages.read(spark, out, "dataset").select(F.lit("dataset").alias("part"), "sha", F.col("main_lang").alias("name"), "message", "patch", "split"),
        stages.read(spark, out, "raw_diffs").select(F.lit("raw"), "sha", "path", "message", F.coalesce("patch", none), none),
        stages.read(spark, out, "metadata").select(F.lit("metadata"), "sha", "owner", "subject", none, none),
    ]
    return reduce(DataFrame.union, parts)


@query
def funnel_of_runs(spark, sf_dir):
    """The steps of the funnel as counted by two landing and two annotation runs while they wrote their rows."""
    source, landed, out = (scratch.new_folder(spark) for _ in range(3))
    rows = _metadata_rows(spark, sf_dir)
    for turn in range(2):
        X.write_metadata(rows.where((_turn() == 1) == F.lit(turn == 1)), source)
        landing.land(spark, landing.METADATA, source, landed)
        landing.annotate_landed(spark, landed, out, token_parser, sentence_parser)
    counts = landing.run_counts(spark, landed) | landing.run_counts(spark, out)
    steps = ("scraped", "annotated", *corpus.funnel_rules())
    return spark.createDataFrame([tuple(counts.get(s, 0) for s in steps)], ", ".join(f"{s} long" for s in steps))


@query
def stream_equals_batch(spark, sf_dir):
    """Diff files ingested as a stream, every ninth unreadable: processed rows, and a row per file set aside."""
    source, out, checkpoint = (scratch.new_folder(spark) for _ in range(3))
    key = P.repo_key(F.col("owner"), F.col("repo"))
    rows = X.commit_files(spark, sf_dir).withColumns({"repo_key": key, "broken": F.col("doc_id") % 9 == 4})
    X.write_diffs(rows, source)
    ingest_stream(spark, source, out, checkpoint).awaitTermination()
    lost = spark.read.parquet(f"{out}-rejected").select("reason")
    columns = [F.lit("").alias(c) for c in ("main_lang", "message", "patch")]
    stored = spark.read.parquet(out).select("main_lang", "message", "patch", F.lit("").alias("reason"))
    return stored.unionByName(lost.select(*columns, "reason"))


@query
def publish_job(spark, sf_dir):
    """Fitting commits as published: random order and split."""
    processed = preprocess_job(spark, sf_dir).select(*schemas.PROCESSED.fieldNames())
    return jobs.published(processed, "7")


@query
def fitting_by_repo(spark, sf_dir):
    """Commits fitting the requirements, per repository."""
    return _annotated(spark, sf_dir).groupBy("owner", "repo").agg(
        F.count("*").alias("commits"), F.count_if("fits_requirements").alias("fitting")
    )
