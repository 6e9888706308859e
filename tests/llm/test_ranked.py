import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from commitloom.llm import ranked

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_terms(text):
    return TERM.findall((text or "").translate(UPPER))


def plain_rank(docs, items, top):
    """(item place, rank, key, score): all documents scored for every item."""
    counts = [(k, Counter(plain_terms(t))) for k, t in docs]
    counts = [(k, c, sum(c.values())) for k, c in counts if c]
    documents, length = len(counts), sum(n for _, _, n in counts)
    holding = Counter(t for _, c, _ in counts for t in c)
    out = []
    for i, text in enumerate(items):
        found = []
        for key, c, n in counts:
            m = 50 + 50 * n * documents // length
            score = sum(ranked.weight(documents, holding[t]) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(plain_terms(text)) if c[t])
            if score > 0:
                found.append((key, score))
        found.sort(key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        out += [(i, r + 1, *f) for r, f in enumerate(found[:top])]
    return out


@given(st.text(max_size=60) | st.text(alphabet="aZ09É日_@[`{\x7f \x80İ", max_size=40))
def test_terms_equal_the_pattern(text):
    text = text.encode("utf-8", "ignore").decode()
    assert [t.decode() for t in ranked.terms_of(text)] == plain_terms(text)


words = st.lists(st.sampled_from("abcdefghij"), max_size=8).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(words, min_size=1, max_size=60), st.lists(words, min_size=1, max_size=20), st.integers(1, 6), st.integers(0, 3))
def test_dual_search_equals_all_pairs(docs, texts, top, seed):
    block = ranked.Items(texts)
    width = len(block.vocabulary)
    weights = np.random.default_rng(seed).integers(0, 9, width)
    vectors = [Counter(block.vocabulary[t] for t in ranked.terms_of(d) if t in block.vocabulary) for d in docs]
    keys = [i for i, v in enumerate(vectors) if v]
    want = []
    for i, terms in enumerate(block.terms):
        scores = [(sum(int(weights[t]) * vectors[k][t] for t in terms), k) for k in keys]
        want.append(sorted(((-s, k) for s, k in scores if s > 0))[:top])
    best = ranked.Best(len(texts), top, np.zeros(len(texts), np.int64))
    half = len(keys) // 2
    for some in (keys[:half], keys[half:]):  # the bounds of the first documents hold for the next
        if some and width:
            terms = np.array([t for k in some for t in vectors[k]])
            values = np.array([int(weights[t]) * c for k in some for t, c in vectors[k].items()])
            tree = ranked.Documents(values, terms, np.array([len(vectors[k]) for k in some]), width)
            ranked.dual_search(block.hierarchy(weights), tree, some, best)
    assert [sorted((-s, k) for s, k in zip(best.scores[i].tolist(), best.keys[i])) for i in range(len(texts))] == want


def test_bounds_prune_whole_batches():
    rng = np.random.default_rng(1)
    texts = [" ".join(f"i{i}x{j}" for j in range(20)) for i in range(64)]
    block = ranked.Items(texts)
    weights = np.full(len(block.vocabulary), 100)
    docs = [rng.choice(block.terms[i % 64], 12, replace=False) for i in range(2048)]
    tree = ranked.Documents(np.full(12 * 2048, 7), np.concatenate(docs), np.full(2048, 12), len(block.vocabulary))
    best = ranked.Best(64, 5, np.zeros(64, np.int64))
    looked = ranked.dual_search(block.hierarchy(weights), tree, list(range(2048)), best)
    assert all(len(k) == 5 for k in best.keys) and looked < 64 * 2048 / 10


@pytest.mark.parametrize("block, terms, seed", [(2000, 50_000, 64), (2, 50_000, 1), (2000, 3, 2)])
def test_rows_of_every_kind(spark, monkeypatch, block, terms, seed):
    monkeypatch.setattr(ranked, "BLOCK", block)
    monkeypatch.setattr(ranked, "TERMS", terms)
    monkeypatch.setattr(ranked, "SEED", seed)
    texts = ["a b c", "A-b,C", "a b c", None, "", "!?", "a " * 5000, "É é d", "b c d e f", "b c d e f", "c", "x y z"]
    docs = [(None if i == 2 else i % 10, t, 1, 2.0) for i, t in enumerate(texts)] * 2
    wanted = [(0, "a c"), (0, "a c"), (None, "É b"), (7, None), (8, "nothing here"), (9, ".a.A.a")]
    table = spark.createDataFrame(docs, "doc_id long, text string, rank int, score double").repartition(4)
    items = spark.createDataFrame([(*w, 5) for w in wanted], "item_id long, text string, doc_id int").coalesce(1)
    got = sorted(map(tuple, ranked.rank(table, items, 5).collect()), key=str)
    want = [(wanted[i][0], r, k, s) for i, r, k, s in plain_rank([d[:2] for d in docs], [w[1] for w in wanted], 5)]
    assert got == sorted(want, key=str)
    assert ranked.rank(table.limit(0), items).count() == 0 and ranked.rank(table, items.limit(0)).count() == 0


def test_the_query_equals_its_sql(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = sorted(con.execute(f"SELECT item_id, rank, doc_id, score FROM ({ranked.SQL})").fetchall())
    assert sorted(map(tuple, ranked.rank(docs, items).collect())) == want
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    ids, texts = zip(*[(r.item_id, r.text) for r in items.collect()])
    assert sorted((ids[i], r, k, s) for i, r, k, s in plain_rank(rows, texts, 50)) == want
