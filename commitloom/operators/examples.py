"""Published rows to model inputs: row selection, prompts, encoding, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ExampleConfig
from ..functions import arrays as A
from ..functions import message as M
from ..functions import patch as P
from ..functions.text import present
from .corpus import debug_head
from .filters import drop_null_messages, for_language, single_file, unmixed
from .vocabulary import encode


def select_examples(df: DataFrame, config: ExampleConfig) -> DataFrame:
    """Rows a run trains on: the debug head if asked for, then one-file and unmixed commits."""
    if config.debug:
        df = debug_head(df, n=config.debug_rows)
    df = single_file(df, config.allow_multi_file_commits)
    return unmixed(df, config.allow_mixed_files)


def mlm_examples(
    df: DataFrame, vocab: DataFrame, config: ExampleConfig = ExampleConfig(), key: str = "sha"
) -> DataFrame:
    """(key, input_ids, attention_mask, special_tokens_mask, labels); only message tokens carry
    labels. A row whose message alone is too long has null arrays, for ``quarantine``."""
    prompted = select_examples(df, config).select(
        key, "patch", M.message_prompt(F.col("message")).alias("prompt")
    )
    encoded = encode(prompted, ["patch", "prompt"], vocab, key)
    packed = encoded.select(
        key,
        A.pack_pair(F.col("patch_ids"), F.col("prompt_ids"), config.max_input_size).alias("x"),
    ).select(key, "x.*")
    spanned = packed.withColumn("span", A.message_span(F.col("input_ids")))
    labelled = A.message_labels(F.col("input_ids"), F.col("special_tokens_mask"), F.col("span"))
    return spanned.withColumn("y", labelled).select(
        key, "input_ids", "attention_mask", "y.special_tokens_mask", "y.labels"
    )


def masked_examples(
    packed: DataFrame, key: str = "sha", seed: str = "0"
) -> DataFrame:
    """(key, input_ids, position, answer): one masked message token per (key, input_ids, span)
    row; a row without message tokens goes."""
    one = A.mask_one(F.col("input_ids"), F.col("span"), F.col(key), seed)
    return packed.select(key, present(one))


def seq2seq_examples(
    df: DataFrame, vocab: DataFrame, config: ExampleConfig = ExampleConfig(), key: str = "sha"
) -> DataFrame:
    """(key, input_ids, attention_mask, labels) of patch -> message; null messages go."""
    rows = drop_null_messages(select_examples(df, config)).select(key, "patch", "message")
    encoded = encode(rows, ["patch", "message"], vocab, key)
    packed = A.pack_seq2seq(
        F.col("patch_ids"), F.col("message_ids"), config.max_input_size, config.max_target_size
    )
    return encoded.select(key, packed.alias("x")).select(key, "x.*")


def prepare_eval(df: DataFrame, compat: bool = False, lang: str | None = None) -> DataFrame:
    """(patch, message, main_lang) as scored: collapsed prompt, special tokens scrubbed.

    ``compat`` turns the tags back to diff signs, for baseline models.
    """
    patch = P.scrub_special(F.col("patch"))
    return for_language(df, lang).withColumns(
        {
            "patch": P.untag(patch) if compat else patch,
            "message": M.message_prompt(F.col("message"), collapse=True),
        }
    )
