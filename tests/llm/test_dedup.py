import math

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from commitloom.llm import embeddings, simhash
from commitloom.llm.components import connected_components


def classes(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_paths_stars_and_loops(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200), (300, 100)]
    found = {r[0]: r[1] for r in connected_components(spark.createDataFrame(pairs, "x long, y long")).collect()}
    assert found == {n: r for n, r in classes({n for p in pairs for n in p}, pairs).items()}
    assert connected_components(spark.createDataFrame([], "x long, y long")).count() == 0


def plain_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abA É\n\t  ", max_size=60) | st.none())
def test_fingerprint(text):
    assert simhash.fingerprint_of(text) == plain_print(text)


def test_near_duplicates_equal_all_pairs(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 1)  # both ways of the look-up are used
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = [(None, "a b c"), (9001, "A b\tc"), (9002, None), (9003, ""), (9004, " \n"), (9001, "a b c"), (9005, "x " * 30000)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    rows = [(r.doc_id, plain_print(r.text)) for r in docs.collect()]
    prints = sorted({p for _, p in rows})
    linked = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 3]
    of = classes(prints, linked)
    least = {}
    for key, p in rows:
        if key is not None:
            least[of[p]] = min(key, least.get(of[p], key))
    want = sorted((repr(k), f"{p:016x}", least.get(of[p])) for k, p in rows)
    found = simhash.near_duplicates(docs.withColumn("fp", F.lit(1)).withColumn("component", F.lit("x")))
    assert sorted((repr(r.doc_id), r.fingerprint, r.component_id) for r in found.collect()) == want
    kept = simhash.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))
    assert kept.columns == docs.columns


def test_one_row_of_each_component_is_kept(spark):
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(6)]
    rows = [(None, t) for t in texts[:4]] + [(None, texts[0]), (5, texts[3]), (7, texts[4]), (7, texts[5]), (7, texts[5]), (8, texts[5])]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, source string")
    kept = simhash.keep_one(docs)
    want = [(None, t) for t in texts[:3]] + [(5, texts[3]), (7, texts[4]), (7, texts[5])]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert kept.columns == docs.columns


def test_near_dedup_stage_equals_all_pairs_of_fingerprints(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = [(None, "only here"), (9901, "A b\tc"), (9902, "a B c"), (9903, None), (9904, " "), (None, "a b c"), (9905, "x " * 30000), (9905, "other text of a repeated key")]
    rows = [tuple(r) for r in docs.collect()] + odd * 2
    prints = [plain_print(t) for _, t in rows]
    distinct = sorted(set(prints))
    of = classes(distinct, [(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if (a ^ b).bit_count() <= 3])
    least = {}
    for (key, _), p in zip(rows, prints):
        least[of[p]] = min([k for k in (key, least.get(of[p])) if k is not None], default=None)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    table = table.withColumns({"component": F.lit(1), "row": F.create_map(F.lit("a"), F.lit(2)), "fp": F.lit("x")})
    found = corpus_pipeline.near_dedup(spark, table, sf_dir)
    assert found.columns == table.columns
    assert sorted((r.doc_id for r in found.collect()), key=repr) == sorted(least.values(), key=repr)
    assert corpus_pipeline.near_dedup(spark, table.limit(0), sf_dir).count() == 0


def test_links_of_planted_prints(spark):
    random = np.random.default_rng(1)
    base = random.integers(0, 2**63, 20, dtype=np.int64)
    prints = {int(b) for b in base}
    for b in base:
        for bits in (1, 2, 3, 4, 5):
            flips = random.choice(64, bits, replace=False)
            prints.add(int(np.int64(b) ^ np.array([1 << int(f) for f in flips], np.uint64).sum(dtype=np.uint64).astype(np.int64)))
    rows = sorted(prints)
    mask = (1 << 64) - 1
    want = {(a, b) for i, a in enumerate(rows) for b in rows[:i] if ((a ^ b) & mask).bit_count() <= 3}
    found = simhash.links(spark.createDataFrame([(p,) for p in rows], "fp long")).collect()
    assert {(max(r.u, r.v), min(r.u, r.v)) for r in found} == want


def plain_links(rows, threshold=0.93):
    def sound(vector, label):
        return label is not None and vector and all(x is not None and math.isfinite(x) for x in vector) and any(vector)

    pairs = []
    for i, (_, v, label) in enumerate(rows):
        for j, (_, w, other) in enumerate(rows[:i]):
            if sound(v, label) and sound(w, other) and label == other and len(v) == len(w):
                v_, w_ = np.array(v, float), np.array(w, float)
                if v_ @ w_ / (np.linalg.norm(v_) * np.linalg.norm(w_)) >= threshold:
                    pairs.append((i, j))
    return pairs


def test_embeddings_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 8)  # many blocks and levels
    monkeypatch.setattr(embeddings, "FAN", 3)
    random = np.random.default_rng(3)
    centres = random.normal(size=(12, 10))
    rows = []
    for i in range(240):
        v = centres[i % 12] + random.normal(size=10) * (0.12 if i % 3 else 0.4)
        rows.append((i + 10, [float(np.float32(x)) for x in v * (1 + i % 4)], int(i % 2)))
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(30)]  # copies
    rows += [(1, rows[5][1], None), (2, None, 0), (3, [0.0] * 10, 0), (4, [float("nan")] * 10, 0), (5, [None] * 10, 0), (6, [], 0), (7, [1.0, 2.0], 1), (8, [2.0, 4.0], 1)]
    rows += [(9, [float("inf")] + [1.0] * 9, 0), rows[0]]
    pairs = plain_links(rows)
    places = classes(range(len(rows)), pairs)
    counts = np.bincount(np.array(pairs).ravel(), minlength=len(rows))
    least = {}
    for i, (key, *_) in enumerate(rows):
        least[places[i]] = min(key, least.get(places[i], key))
    want = sorted((key, int(counts[i]), least[places[i]], key == least[places[i]]) for i, (key, *_) in enumerate(rows))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = embeddings.near_duplicates(table.withColumn("copies", F.lit("x")).withColumn("links", F.lit(0)))
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(tuple(r) for r in found.collect()) == want


def test_distant_blocks_are_skipped_and_empty_tables_work(spark):
    rows = [(i, [1.0 + i / 1e4, 0.0], 0) for i in range(4)] + [(i, [0.0, 1.0 + i / 1e4], 0) for i in range(4, 8)]
    at = spark.createDataFrame([(0, 2, n, *([float(n)] * 12)) for n in range(30)], "label int, width int, at long, " + ", ".join(f"{c} double" for c in [*embeddings._LOW, *embeddings._HIGH]))
    pairs = {(r.a, r.b) for r in embeddings.interval_pairs(at, 2.5).collect()}
    assert pairs == {(a, b) for a in range(30) for b in (a, a + 1) if b < 30}  # sqrt(6) a step
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(table).filter("n_links = 3").count() == 8
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def test_links_broadcast_no_exploded_side(spark):
    """Look-ups are many times the size they are estimated at: a broadcast of them would go through the driver."""
    plan = simhash.links(spark.range(50).select(F.xxhash64("id").alias("fp")))._jdf.queryExecution().sparkPlan().toString()
    verified = [line for line in plan.splitlines() if "Join" in line and "bit_count" in line]
    assert len(verified) == 2 and all("SortMergeJoin" in line for line in verified)
