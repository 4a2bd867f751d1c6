"""Near duplicates of documents and embeddings against brute force, and their edge cases."""

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from listingflow.llm import minhash, near_vectors
from listingflow.llm.graph import components

DOCS = "doc_id long, text string, kept string, key long"


def shingles(text):
    lowered = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not words:
        return set()
    if len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def smallest(nodes, edges):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def brute_documents(rows):
    sets = {i: shingles(t) for i, t in rows}
    edges = [
        (a, b)
        for a, b in itertools.combinations(sets, 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    label = smallest(sets, edges)
    return {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


def variants(seed, groups=6, copies=12, words=120):
    """Groups of texts at all distances: copies, few edits, edits around the limit."""
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        for c in range(copies):
            text = list(base)
            for _ in range(c // 2):
                text[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(text))
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_documents_match_brute_force(frame, seed):
    rows = variants(seed)
    got = minhash.near_duplicates(frame([(i, t, "a", 1) for i, t in rows], DOCS)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_documents(rows)


def test_documents_of_the_small_table_match_brute_force(corpus):
    rows = [(r.doc_id, r.text) for r in corpus("documents").select("doc_id", "text").collect()]
    got = minhash.near_duplicates(corpus("documents")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_documents(rows)


def test_document_edge_cases(frame):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [
        (5, None), (6, ""), (7, " \t\n"), (8, "One Two"), (9, "one\x0btwo"), (10, "one  two "), (11, "one two three"),
        (12, "É b c d e f"), (13, "é b c d e f"), (14, long), (15, long + " end"), (None, "one two"), (20, "a b c d e"), (20, "a b c d e"),
        (21, "A b c d e"),
    ]
    got = minhash.near_duplicates(frame([(i, t, "x", None) for i, t in rows], DOCS))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    table = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()}
    assert table == {
        (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 1, 8, True), (9, 1, 8, False), (10, 1, 8, False), (11, 1, 11, True),
        (12, 2, 12, True), (13, 2, 13, True), (14, 59_996, 14, True), (15, 59_997, 14, False), (None, 1, None, True), (20, 1, 20, True),
        (21, 1, 20, False),
    }
    kept = minhash.without_near_duplicates(frame([(i, t, "x", None) for i, t in rows], DOCS))
    assert kept.columns == ["doc_id", "text", "kept", "key"]
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 5, 6, 7, 8, 11, 12, 13, 14, 20]


def test_blocks_of_short_texts_are_bounded(frame, monkeypatch):
    """However few shingles the members of a hub have, no task compares more documents at
    once than two blocks hold."""
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 40)

    def sizes(percent):
        def run(batches):
            found = {}
            for batch in batches:
                for key in zip(*(batch.column(c).to_pylist() for c in ("hub", "kind", "i", "j"))):
                    found[key] = found.get(key, 0) + 1
            n = pa.array(found.values(), pa.int64())
            yield pa.RecordBatch.from_arrays([n, n], names=["a", "b"])

        return run

    monkeypatch.setattr(minhash, "_compared", sizes)
    ids = range(1, 1001)
    got = minhash._rest(
        frame([(1, i, 4) for i in ids], "hub long, doc_id long, n long"), frame([], "node long, component long"),
        frame([(i, [i, 2, 3, 4]) for i in ids], "doc_id long, shingles array<long>"), 75,
    )
    assert 0 < max(r.a for r in got.collect()) < 160


def test_short_texts_in_many_blocks_match_brute_force(frame, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 40)
    rows = [(i, f"this text is the same but for {i}") for i in range(1, 301)]
    rows += [(1000 + i, f"this text is the same but for {i} and") for i in range(1, 20)]
    got = minhash.near_duplicates(frame([(i, t, "x", 0) for i, t in rows], DOCS)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_documents(rows)


def test_tiles_compare_as_one(monkeypatch):
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 30, rng.integers(1, 20))) for _ in range(50)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    for tile in (1, 7, 50, 64):
        assert np.concatenate([x for _, x in minhash.overlaps(sets, tile)]).tolist() == want


def test_all_texts_of_a_doc_id_are_compared():
    words = lambda text: np.array(sorted({hash(w) for w in text.split()}), np.int64)
    rows = [(1, words("a b c d e f g h")), (2, words("q r s t")), (2, words("a b c d e f g h i"))]
    columns = {c: pa.array([0] * 3, pa.int64()) for c in ("hub", "kind", "i", "j")}
    batch = pa.RecordBatch.from_pydict(
        columns | {"doc_id": pa.array([i for i, _ in rows]), "shingles": pa.array([s for _, s in rows], pa.list_(pa.int64()))}
    )
    got = [p for b in minhash._compared(75)(iter([batch])) for p in b.to_pylist()]
    assert got == [{"a": 2, "b": 1}]


def test_no_documents(frame):
    assert minhash.near_duplicates(frame([], DOCS)).collect() == []
    assert minhash.without_near_duplicates(frame([], DOCS)).collect() == []


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=300, unique=True))
def test_signature_keeps_both_ends_of_each_permutation(values):
    x = np.array(values, np.uint64)
    got = minhash.signature(x)
    a, b = minhash._permutations(minhash.BANDS * minhash.ROWS // 2)
    small = (x >> np.uint64(32)).astype(np.uint32)
    every = a * small[None, :] + b
    assert (got[0::2] == every.min(axis=1)).all() and (got[1::2] == every.max(axis=1)).all()


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(0)
    shared, own = rng.integers(0, 2**63, 600).astype(np.uint64), rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = np.concatenate([shared, own[:200]]), np.concatenate([shared, own[200:]])
    assert abs(np.mean(minhash.signature(a) == minhash.signature(b)) - 0.6) < 0.1


def test_components_of_chains_and_stars(frame):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 300)] + [(500, 500), (299, 700), (700, 650)]
    got = {r.node: r.component for r in components(frame(edges, "a long, b long")).collect()}
    want = smallest({n for e in edges for n in e}, edges)
    assert got == {n: c for n, c in want.items() if n != 500}
    assert components(frame([], "a long, b long")).collect() == []


# Embeddings

VECTORS = "vec_id long, embedding array<float>, label int, n_links string"


def brute_vectors(rows):
    usable = {
        i: np.array(v, float) / np.linalg.norm(np.array(v, float))
        for i, v in rows
        if v and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)
    }
    edges = [(a, b) for a, b in itertools.combinations(usable, 2) if len(usable[a]) == len(usable[b]) and usable[a] @ usable[b] >= 0.95]
    label = smallest([i for i, _ in rows], edges)
    links = dict.fromkeys(label, 0)
    for a, b in edges:
        links[a] += 1
        links[b] += 1
    return {i: (links[i], label[i], label[i] == i) for i in label}


def cloud(seed, spreads, size, dims=24):
    """Groups of vectors around centres, tight and loose."""
    rng = np.random.default_rng(seed)
    rows = []
    for spread in spreads:
        centre = rng.standard_normal(dims)
        rows += [(centre + spread * rng.standard_normal(dims)).tolist() for _ in range(size)]
    order = rng.permutation(len(rows))
    return [(int(i) + 1, np.float32(rows[j]).tolist()) for i, j in enumerate(order)]


@pytest.mark.parametrize("seed", [3, 4])
def test_vectors_match_brute_force(frame, seed):
    rows = cloud(seed, [0.0, 0.02, 0.1, 0.15, 0.2, 0.25, 1.0], 60)
    got = near_vectors.near_vectors(frame([(i, v, 0, "x") for i, v in rows], VECTORS)).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute_vectors(rows)


def test_dense_component_larger_than_a_window(frame):
    rows = cloud(9, [0.16], 700)
    got = near_vectors.near_vectors(frame([(i, v, 0, "x") for i, v in rows], VECTORS)).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute_vectors(rows)


def test_vector_edge_cases(frame):
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 2.0]),
        (8, [1.0, 2.0]), (9, [2.0, 4.0]), (10, [-1.0, -2.0]), (11, [1.0, 2.0, 0.0]), (12, [1e-30, 2e-30]), (13, [3e38, 3e38]),
    ]
    got = near_vectors.near_vectors(frame([(i, v, None, None) for i, v in [*rows, (None, [1.0, 2.0])]], VECTORS))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    table = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got.collect()}
    assert table.pop(None) == (0, None, True)
    assert table == brute_vectors(rows)
    assert near_vectors.near_vectors(frame([], VECTORS)).collect() == []


def test_repeated_vector_rows_count_each_other(frame):
    got = near_vectors.near_vectors(frame([(1, [1.0, 0.5], 0, "")] * 2 + [(2, [0.0, 1.0], 0, "")], VECTORS)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (1, 1, 1), (2, 0, 2)]


def test_recall_over_the_small_table(corpus):
    rows = [(r.vec_id, r.embedding) for r in corpus("embeddings").collect()]
    want = brute_vectors(rows)
    got = {r.vec_id: r.n_links for r in near_vectors.near_vectors(corpus("embeddings")).collect()}
    assert sum(got.values()) >= 0.9 * sum(w[0] for w in want.values())
    assert all(got[i] <= want[i][0] for i in got)
