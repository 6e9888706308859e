from commitloom import schemas
from commitloom.functions import verb_object as V

TOKENS = schemas.PARSE_TOKENS.simpleString()
SENTENCES = schemas.PARSE_SENTENCES.simpleString()


def token(text, dep, head, tag="NN"):
    return (text, dep, tag, head)


VERB = token("add", "ROOT", 0, "VB")


def test_token_rule(values):
    cases = [
        ([], False),
        ([VERB], False),
        ([VERB, token("parser", "dobj", 0)], True),
        ([VERB, token("a", "det", 2), token("parser", "dobj", 0)], True),
        ([VERB, token("now", "advmod", 0), token("parser", "dobj", 0)], False),
        ([token("adds", "ROOT", 0, "VBZ"), token("parser", "dobj", 0)], False),
        ([token("add", "nsubj", 1, "VB"), token("parser", "dobj", 0)], False),
        # another word of the object's spelling governs: passes
        (
            [VERB, token("a", "det", 3), token("parser", "dobj", 0), token("parser", "pobj", 2)],
            True,
        ),
        # the first of two objects counts
        ([VERB, token("x", "dobj", 0), token("y", "det", 0), token("z", "dobj", 0)], True),
        (None, None),
    ]
    assert values([c[0] for c in cases], TOKENS, V.verb_object_spacy) == [c[1] for c in cases]


def word(id, deprel, head, xpos="NN"):
    return (id, deprel, xpos, head)


ROOT = word(1, "root", 0, "VB")


def test_sentence_rule(values):
    cases = [
        ([], False),
        ([[]], False),
        ([[ROOT, word(2, "obj", 1)]], True),
        ([[ROOT, word(2, "det", 3), word(3, "obj", 1)]], True),
        # governed by another word, whatever its spelling
        ([[ROOT, word(2, "det", 4), word(3, "obj", 1), word(4, "obl", 1)]], False),
        # only the first sentence counts
        ([[ROOT], [ROOT, word(2, "obj", 1)]], False),
        (None, None),
    ]
    assert values([c[0] for c in cases], SENTENCES, V.verb_object_stanza) == [c[1] for c in cases]
