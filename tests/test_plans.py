"""What the planner makes of the operators: shuffles, Python, columns read."""

import pytest
from pyspark.sql import functions as F

from commitloom import catalog
from commitloom import fixtures as X
from commitloom.functions import patch as P
from commitloom.sources import scratch
from commitloom.operators import corpus, evaluation, vocabulary
from commitloom.operators import annotate as ann
from commitloom.operators import parsing


@pytest.fixture
def plan(capsys):
    def text(df):
        capsys.readouterr()
        df.explain("simple")
        return capsys.readouterr().out

    return text


MAP_ONLY = [
    "annotate_rules", "requirements_mask", "verb_object_spacy", "tag_patch", "serialize_commit_v1",
    "content_type", "explode_files", "drill_job", "split", "prepare_eval", "message_lengths",
]


@pytest.mark.parametrize("name", MAP_ONLY)
def test_row_local_work_never_shuffles(spark, sf_dir, plan, name):
    text = plan(catalog.QUERIES[name](spark, sf_dir))
    assert "Exchange" not in text and "EvalPython" not in text


def test_only_parsers_and_ngram_counts_leave_the_jvm(spark, sf_dir, plan):
    python = {name for name, query in catalog.QUERIES.items() if "EvalPython" in plan(query(spark, sf_dir))}
    assert python == {
        "with_verb_object", "annotate_job", "drill_job_with_parsers", "corpus_bleu", "corpus_bleu_by_language",
        "corpus_bleu_nulls", "bleu_report",
    }


def test_each_parser_runs_once_and_above_the_rules(spark, sf_dir, plan):
    rows = ann.annotate_rules(ann.with_subject(X.commits(spark, sf_dir)))
    parsed = parsing.with_verb_object(
        rows.where(ann.cheap_rules()), catalog.token_parser, catalog.sentence_parser, F.lit(True)
    )
    text = plan(parsed.where("verb_object_spacy OR verb_object_stanza").select("sha"))
    assert text.count("ArrowEvalPython [") == 2
    assert text.rindex("Filter") > text.rindex("ArrowEvalPython [")


def test_languages_read_file_names_only(spark, sf_dir, plan):
    text = plan(X.commit_files(spark, sf_dir).select("sha", P.content_type(F.col("files"))))
    assert "ReadSchema: struct<sha:string,files:array<struct<filename:string>>>" in text


def test_the_semi_join_comes_before_the_text_work(spark, sf_dir, plan):
    text = plan(catalog.preprocess_job(spark, sf_dir))
    assert text.index("array_join") < text.index("LeftSemi")


def test_bleu_shuffles_sums_only(spark, sf_dir, plan):
    text = plan(evaluation.bleu_report(X.eval_pairs(spark, sf_dir)))
    assert text.count("FileScan") == 1 and "Join" not in text
    # the lowest exchange, the only one over more than a few rows, carries counts and no text
    below = text[text.rindex("Exchange") :]
    assert "partial_sum(m1" in below and "prediction" not in text[: text.rindex("Exchange")]


def test_top_rows_need_no_sort_of_the_table(spark, sf_dir, plan):
    rows = X.commits(spark, sf_dir)
    assert "TakeOrderedAndProject" in plan(corpus.sample_rows(rows, 10))
    text = plan(corpus.debug_head(corpus.split(rows)))
    # one scan, and at most n rows a split from each partition are shuffled
    assert text.count("FileScan") == 1 and text.rindex("WindowGroupLimit") > text.index("Exchange")


def test_random_order_needs_no_sample_of_the_table(spark, sf_dir, plan):
    text = plan(corpus.shuffle(X.commits(spark, sf_dir)))
    assert text.count("Exchange") == 1 and "rangepartitioning" not in text


def test_encoding_moves_no_row_unless_the_vocabulary_is_large(spark, sf_dir, plan):
    rows = X.commits(spark, sf_dir)
    vocab = scratch.stored(vocabulary.build_vocab(rows, ["message"], 50))
    assert "Exchange" not in plan(vocabulary.encode(rows, ["message"], vocab, "sha"))
    text = plan(vocabulary.encode(rows, ["message"], vocab, "sha", inline=20))
    assert text.count("FileScan") <= 3 and "hashpartitioning(sha" not in text  # rows meet their tokens by a short hash


def test_tokens_are_counted_before_the_shuffle(spark, sf_dir, plan):
    text = plan(vocabulary.count_tokens(X.commits(spark, sf_dir), ["message"]))
    assert text.count("Exchange") == 1 and "partial_count" in text[text.index("Exchange") :]


def test_split_reads_its_partition(spark, sf_dir, plan, tmp_path):
    from commitloom.sources import readers, writers

    writers.export_splits(corpus.split(X.commits(spark, sf_dir)), str(tmp_path / "d"))
    text = plan(readers.read_dataset(spark, str(tmp_path / "d"), "test").select("sha"))
    assert "PartitionFilters: [isnotnull(split" in text and "ReadSchema: struct<sha:string>" in text


@pytest.mark.parametrize("build", [X._build_commit_files, X._build_eval_pairs, X.spread_documents])
def test_built_tables_exchange_the_documents_only(spark, sf_dir, plan, build):
    """Spread before they are built, and without a sort: a commit holds its text two to four times."""
    text = plan(build(spark, sf_dir))
    assert text.count("Exchange") == 1 and "hashpartitioning(doc_id" in text and "Sort" not in text
    below = text[text.index("Exchange") :]
    assert "md5" not in below and "array_join" not in below
