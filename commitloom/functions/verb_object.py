"""Verb-object rules over parse tokens; the parser itself is the user's hook."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The dependency and part-of-speech tags the rules look for.
BASE_VERB = "VB"


def _between(tokens: Column, object_at: Column) -> Column:
    """Tokens after the verb and before the object at this 1-based position."""
    return F.slice(tokens, F.lit(2), F.greatest(object_at.cast("int") - 2, F.lit(0)))


def verb_object_spacy(tokens: Column) -> Column:
    """First token a base-form root verb, then a direct object, all between them governed by it.

    Governors are compared by their text, so another word of the same spelling passes.
    A null parse gives null: not evaluated.
    """
    first = F.get(tokens, F.lit(0))
    object_at = F.array_position(tokens["dep"], "dobj")
    words = tokens["text"]
    object_text = F.get(words, object_at.cast("int") - 1)
    governed = F.forall(_between(tokens, object_at), lambda t: F.get(words, t["head"]) == object_text)
    rule = (first["dep"] == "ROOT") & (first["tag"] == BASE_VERB) & (object_at > 0) & governed
    return F.when(tokens.isNotNull(), F.coalesce(rule, F.lit(False)))


def verb_object_stanza(sentences: Column) -> Column:
    """The same rule on the first sentence, governors compared by word id."""
    sentence = F.get(sentences, F.lit(0))
    first = F.get(sentence, F.lit(0))
    object_at = F.array_position(sentence["deprel"], "obj")
    object_id = F.get(sentence["id"], object_at.cast("int") - 1)
    governed = F.forall(_between(sentence, object_at), lambda w: w["head"] == object_id)
    rule = (first["deprel"] == "root") & (first["xpos"] == BASE_VERB) & (object_at > 0) & governed
    return F.when(sentences.isNotNull(), F.coalesce(rule, F.lit(False)))
