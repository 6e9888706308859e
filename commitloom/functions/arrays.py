"""Training-example arrays: packing, labels, masking.

Spans are cut with ``slice`` and ``array_repeat`` and not by an index lambda: a
lambda evaluates the span borders again for each element.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import hex_number, key_hash
from .text import bind, words

# Ids of the special tokens and the label that losses ignore.
START, PAD, SEP, UNKNOWN, MASK = 0, 1, 2, 3, 4
IGNORED = -100
MASK_TOKEN = "<mask>"

_DRAW_RANGE = 16**4


def _ints(value: int, count: Column) -> Column:
    return F.array_repeat(F.lit(value), F.greatest(count, F.lit(0)).cast("int"))


def _cut(array: Column, start: Column, end: Column) -> Column:
    """Elements of the 0-based half-open span; empty when it is reversed."""
    return F.slice(array, start.cast("int") + 1, F.greatest(end - start, F.lit(0)).cast("int"))


def fits_pair(patch_ids: Column, message_ids: Column, max_size: int = 512) -> Column:
    """Whether cutting the patch alone brings the pair down to size."""
    left = F.lit(max_size - 4) - F.size(message_ids)
    return (left > 0) | (F.size(patch_ids) <= left)


def pack_pair(patch_ids: Column, message_ids: Column, max_size: int = 512) -> Column:
    """struct<input_ids, attention_mask, special_tokens_mask> of ``<s> A </s></s> B </s>``.

    Only the patch is cut; the rest is padding. Null if the message alone is too long.
    """
    left = F.lit(max_size - 4) - F.size(message_ids)
    n_patch = F.greatest(F.least(F.size(patch_ids), left), F.lit(0))
    n_message = F.size(message_ids)
    used = n_patch + n_message + 4
    padding = F.lit(max_size) - used
    input_ids = F.concat(
        F.array(F.lit(START)),
        _cut(patch_ids, F.lit(0), n_patch),
        F.array(F.lit(SEP), F.lit(SEP)),
        message_ids,
        F.array(F.lit(SEP)),
        _ints(PAD, padding),
    )
    special = F.concat(
        F.array(F.lit(1)),
        _ints(0, n_patch),
        F.array(F.lit(1), F.lit(1)),
        _ints(0, n_message),
        _ints(1, padding + 1),
    )
    return F.when(
        fits_pair(patch_ids, message_ids, max_size),
        F.struct(
            input_ids.alias("input_ids"),
            F.concat(_ints(1, used), _ints(0, padding)).alias("attention_mask"),
            special.alias("special_tokens_mask"),
        ),
    )


def message_span(input_ids: Column) -> Column:
    """struct<start, end> of the message tokens behind its marker; null without three separators."""
    separators = F.array_compact(
        F.transform(input_ids, lambda x, i: F.when(x == SEP, i))
    )
    return bind(
        separators,
        lambda at: F.when(
            F.size(at) >= 3,
            F.struct(
                (F.get(at, F.lit(1)) + 2).alias("start"), F.get(at, F.lit(2)).alias("end")
            ),
        ),
    )


def keep_span(array: Column, span: Column, outside: int) -> Column:
    """The array with every element outside the span replaced."""
    start, end, size = span["start"], span["end"], F.size(array)
    return F.when(start >= end, _ints(outside, size)).otherwise(
        F.concat(_ints(outside, start), _cut(array, start, end), _ints(outside, size - end))
    )


def message_labels(input_ids: Column, special_tokens_mask: Column, span: Column) -> Column:
    """struct<labels, special_tokens_mask>: only message tokens are labelled and maskable."""
    return F.struct(
        keep_span(input_ids, span, IGNORED).alias("labels"),
        keep_span(special_tokens_mask, span, 1).alias("special_tokens_mask"),
    )


def pack_seq2seq(
    source_ids: Column, target_ids: Column, max_source: int = 512, max_target: int = 128
) -> Column:
    """struct<input_ids, attention_mask, labels>: both sides framed, cut and padded."""

    def framed(ids: Column, limit: int) -> Column:
        return F.concat(
            F.array(F.lit(START)), _cut(ids, F.lit(0), F.lit(limit - 2)), F.array(F.lit(SEP))
        )

    def padded(ids: Column, limit: int) -> Column:
        return F.concat(ids, _ints(PAD, F.lit(limit) - F.size(ids)))

    source, target = framed(source_ids, max_source), framed(target_ids, max_target)
    return F.struct(
        padded(source, max_source).alias("input_ids"),
        F.concat(
            _ints(1, F.size(source)), _ints(0, F.lit(max_source) - F.size(source))
        ).alias("attention_mask"),
        ignore_padding(padded(target, max_target)).alias("labels"),
    )


def ignore_padding(ids: Column) -> Column:
    return F.transform(ids, lambda x: F.when(x == PAD, F.lit(IGNORED)).otherwise(x))


def restore_padding(labels: Column) -> Column:
    """Labels back to decodable ids."""
    return F.transform(labels, lambda x: F.when(x == IGNORED, F.lit(PAD)).otherwise(x))


def mlm_mask(
    input_ids: Column,
    special_tokens_mask: Column,
    key: Column,
    vocab_size: Column | int,
    probability: float = 0.5,
    seed: str = "0",
    epoch: int = 0,
) -> Column:
    """struct<input_ids, labels>: masked-language-model noise on the non-special positions.

    A chosen position becomes the mask in 8 of 10 cases, a random id in 1 and stays
    in 1; every other label is ignored. One hash per maskable position drives the
    choice, the kind and the random id.
    """
    size = vocab_size if isinstance(vocab_size, Column) else F.lit(vocab_size)
    place = F.concat(F.lit(f"{seed}:{epoch}:"), key.cast("string"), F.lit(":"))
    draws = F.transform(
        special_tokens_mask,
        lambda s, i: F.when(s == 0, F.md5(F.concat(place, i.cast("string")))),
    )

    def noisy(token: Column, draw: Column) -> Column:
        chosen = draw.isNotNull() & (hex_number(draw, 1, 4) < round(probability * _DRAW_RANGE))
        kind = hex_number(draw, 5, 4)
        replaced = (
            F.when(kind < round(0.8 * _DRAW_RANGE), F.lit(MASK))
            .when(kind < round(0.9 * _DRAW_RANGE), F.pmod(hex_number(draw, 9, 8), size).cast("int"))
            .otherwise(token)
        )
        return F.struct(
            F.when(chosen, replaced).otherwise(token).alias("input"),
            F.when(chosen, token).otherwise(F.lit(IGNORED)).alias("label"),
        )

    noise = F.zip_with(input_ids, draws, noisy)
    return F.struct(noise["input"].alias("input_ids"), noise["label"].alias("labels"))


def _put(array: Column, position: Column, value: Column) -> Column:
    return F.concat(
        _cut(array, F.lit(0), position),
        F.array(value),
        _cut(array, position + 1, F.size(array)),
    )


def mask_one(input_ids: Column, span: Column, key: Column, seed: str = "0") -> Column:
    """struct<input_ids, position, answer>: one message token masked; null for an empty span."""
    length = span["end"] - span["start"]
    draw = hex_number(key_hash(key, seed), 1, 8)
    position = F.when(length > 0, span["start"] + F.pmod(draw, length).cast("int"))
    return bind(
        position,
        lambda at: F.when(
            at.isNotNull(),
            F.struct(
                _put(input_ids, at, F.lit(MASK)).alias("input_ids"),
                at.alias("position"),
                F.get(input_ids, at).alias("answer"),
            ),
        ),
    )


def mask_one_word(message: Column, key: Column, seed: str = "0") -> Column:
    """Message with one word replaced by the mask token; null for a message without words."""
    draw = hex_number(key_hash(key, seed), 1, 8)

    def masked(tokens: Column) -> Column:
        at = F.pmod(draw, F.size(tokens)).cast("int")
        return F.when(F.size(tokens) > 0, F.array_join(_put(tokens, at, F.lit(MASK_TOKEN)), " "))

    return bind(words(message), masked)


def argmax_ids(logits: Column) -> Column:
    """Index of the largest logit, the first on ties."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def subsequence_positions(array: Column, sequence: Column) -> Column:
    """Sorted 0-based positions covered by any occurrence of ``sequence``; [] for an empty one."""
    n = F.size(sequence)
    last = F.size(array) - n
    starts = F.filter(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.slice(array, i + 1, n) == sequence,
    )
    covered = F.flatten(F.transform(starts, lambda i: F.sequence(i, i + n - 1)))
    return F.when((n > 0) & (last >= 0), F.array_sort(F.array_distinct(covered))).otherwise(
        F.array().cast("array<int>")
    )
