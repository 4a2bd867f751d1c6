"""Whitening, byte-level BPE and the Merkle manifest against plain rebuilds."""

import hashlib
import math
import random
import zlib
from decimal import Decimal

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from listingflow.llm import byte_bpe, merkle, whitening
from listingflow.llm.queries import RANKS

DIR = "/root/testdata/sf0.001"


# Byte-level BPE


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBPE.of_file(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(bpe):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aeinrst  \n\t'1\x1c\x85　é日!-=")), max_size=80))
def test_texts_are_encoded_as_by_merges(bpe, reference, text):
    ids = bpe.encode(text)
    assert ids == reference.encode_ordinary(text)
    assert bpe.decode(ids) == text.encode()


def test_long_pieces_are_encoded_as_by_merges(bpe, reference):
    rng = random.Random(3)
    for text in ("a" * 5000, " " * 5000, "ab" * 3000, "é" * 3000, "".join(rng.choice("abcdefgh") for _ in range(20_000)), "0" * 4999):
        assert bpe.encode(text) == reference.encode_ordinary(text)


def test_a_walk_equals_the_merges_of_small_ranks():
    """Ranks in which longest matches are often wrong."""
    rng = random.Random(5)
    ranks = {bytes([b]): b for b in range(256)}
    pieces = ["a", "b", "c"]
    while len(ranks) < 300:
        joined = rng.choice(pieces) + rng.choice(pieces)
        if joined.encode() not in ranks:
            ranks[joined.encode()] = len(ranks)
            pieces.append(joined)
    small = byte_bpe.ByteBPE(ranks, r"\S+|\s+")
    plain = tiktoken.Encoding("small", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    for _ in range(2000):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 30)))
        assert small.encode(text) == plain.encode_ordinary(text), text


def test_ranks_without_a_byte_are_refused():
    with pytest.raises(ValueError):
        byte_bpe.ByteBPE({b"a": 0}, r"\S+")


def test_every_document_round_trips(spark, corpus, reference):
    rows = entry_points.queries()["op12_byte_bpe"](spark, DIR).collect()
    docs = {r.doc_id: r.text or "" for r in corpus("documents").collect()}
    assert {r.doc_id for r in rows} == docs.keys() and len(rows) == len(docs)
    for r in rows:
        ids = reference.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_bpe_edge_cases(frame, reference):
    long = "some words and 1234 numbers \n" * 40_000
    docs = frame(
        [(1, None, "x"), (None, "", "y"), (2, "tie", "z"), (2, "tie", "z"), (3, long, None)], "doc_id long, text string, ids string"
    )
    encoded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert encoded.columns == ["doc_id", "ids"]
    rows = byte_bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in rows) == [
        (0, b""), (1, b""), (2, b"tie"), (2, b"tie"), (3, long.encode()),
    ]
    assert next(r.ids for r in rows if r.doc_id == 3) == reference.encode_ordinary(long)
    empty = byte_bpe.coded_digests(frame([], "doc_id long, text string"), RANKS, public_tokenizers.PATTERN)
    assert empty.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and empty.count() == 0


# Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r, text):
    fields = (r[0], r[3], r[2], r[4], text)
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def plain_tree(digests):
    """The root, and for each leaf its steps ``(before, after)``."""
    steps, of = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for i, at in enumerate(of):
            run = digests[at // 3 * 3 : at // 3 * 3 + 3]
            steps[i].append(("".join(run[: at % 3]), "".join(run[at % 3 + 1 :])))
            of[i] = at // 3
        digests = [h(*digests[i : i + 3]) for i in range(0, len(digests), 3)]
    return digests[0], steps


def plain_manifest(rows):
    """Rows are ``(doc_id, text, lang, source, n_chars)``."""
    sources = {}
    for r in rows:
        sources.setdefault(r[3], []).append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        ordered = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r, r[1])))
        trees.append((ordered, *plain_tree([plain_leaf(r, r[1]) for r in ordered])))
    root, above = plain_tree([t[1] for t in trees])
    out = []
    for (ordered, subroot, steps), beyond in zip(trees, above):
        for r, own in zip(ordered, steps):
            text = r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            got = plain_leaf(r, text)
            for before, after in own + beyond:
                got = h(before, got, after)
            proof = h(*[b + a for b, a in own + beyond])
            out.append((r[0], plain_leaf(r, r[1]), subroot, root, proof, got, got == root))
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RESULT = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def as_rows(df):
    return sorted((tuple(r[c] for c in RESULT) for r in df.collect()), key=str)


def sized_rows(sizes):
    rng = random.Random(7)
    rows = []
    for s, n in enumerate(sizes):
        for _ in range(n):
            text = rng.choice(["a\nb", "plain", None, "", "ü\n\n€", "x" * 50])
            rows.append((len(rows), text, rng.choice(["en", None]), None if s == 0 else f"s{s}", None if text is None else len(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [[1], [3], [4, 1], [2, 81, 82, 1], [0, 5, 244, 30, 7, 9, 10, 3, 3, 3, 28, 27]])
def test_manifest_matches_a_plain_tree(frame, sizes):
    rows = sized_rows(sizes)
    got = as_rows(merkle.verified_manifest(frame(rows, SCHEMA).repartition(5)))
    assert got == sorted(plain_manifest(rows), key=str)


def test_manifest_edge_cases(frame):
    rows = [(None, "a\n", "en", "s", 2), (None, None, None, None, None), (7, "x\ny", "en", "s", 3), (7, "x\ny", "en", "s", 3),
            (7, "other", "en", "é", 5), (8, "long\n" * 300_000, "en", "Z", 9), (-4, "\n", "", "", 1)] + [(7, "same", "en", "s", 4)] * 90
    docs = frame([(*r, "a", "b", 1) for r in rows], SCHEMA + ", steps string, lo string, tree int")
    assert as_rows(merkle.verified_manifest(docs)) == sorted(plain_manifest(rows), key=str)
    empty = merkle.verified_manifest(frame([], SCHEMA))
    assert empty.columns == RESULT and empty.count() == 0


def test_manifest_carries_columns_and_refuses_its_own(frame):
    leaves = frame([(1, "a", h("1"), 5, "p"), (2, "a", h("2"), 6, "q")], "doc_id long, source string, leaf string, lo int, digest string")
    found = merkle.manifest(leaves)
    assert found.columns == ["doc_id", "source", "leaf", "lo", "digest", "steps", "subroot", "root"]
    assert [(r.doc_id, r.lo, r.digest, [tuple(s) for s in r.steps]) for r in found.orderBy("doc_id").collect()] == [
        (1, 5, "p", [("", h("2"))]), (2, 6, "q", [(h("1"), "")]),
    ]
    with pytest.raises(ValueError):
        merkle.manifest(leaves.withColumn("root", F.lit(1)))


# Whitening


def plain_whitening(vectors):
    """Fit list, centred values and covariance of the valid vectors of one length."""
    xs = [[math.floor(256 * c) for c in v] for v in vectors]
    distinct = sorted(set(map(tuple, xs)))
    n, d = len(distinct), len(distinct[0])
    sums = [sum(x[i] for x in distinct) for i in range(d)]
    centred = [[n * x[i] - sums[i] for i in range(d)] for x in distinct]
    cov = np.array([[sum(y[i] * y[j] for y in centred) / n**3 for j in range(d)] for i in range(d)])
    deviation = [sum((n * x[i] - sums[i]) ** 2 for i in range(d)) for x in xs]
    return n, sums, cov, xs, deviation


def check_whitened(rows, ids, vectors, components=4):
    n, sums, cov, xs, deviation = plain_whitening(vectors)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    by = {(r.vec_id, r.component): r for r in rows}
    k = min(components, len(sums))
    assert len(rows) == len(ids) * k
    for c in range(k):
        expected = [np.dot([(n * v - s) / n for v, s in zip(x, sums)], axes[:, c]) / math.sqrt(values[c]) for x in xs]
        got = [by[i, c + 1].whitened for i in ids]
        sign = 1 if np.dot(expected, got) > 0 else -1
        assert np.allclose(got, np.array(expected) * sign, atol=1e-9)
        for i, dev in zip(ids, deviation):
            r = by[i, c + 1]
            assert r.n == n and r.deviation == dev
            assert math.isclose(r.explained, values[c] / np.trace(cov), rel_tol=1e-9)
            assert 0 <= r.identity_error < 1e-9


def test_small_table_is_whitened(spark, corpus):
    rows = entry_points.queries()["op11_embedding_whitening"](spark, DIR).collect()
    known = [r for r in corpus("embeddings").collect() if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    check_whitened(rows, [r.vec_id for r in known], [r.embedding for r in known])


def test_copies_are_fitted_once_and_odd_rows_left_out(frame):
    rng = np.random.default_rng(2)
    good = rng.normal(size=(60, 5)) * [3, 2, 1, 0.5, 0.2]
    rows = [(i, v.tolist(), 1.0, "x") for i, v in enumerate(good)]
    rows += [(100 + i, good[0].tolist(), 1.0, "x") for i in range(40)]  # copies
    odd = [None, [], [1.0, None, 0.0, 0.0, 0.0], [math.nan] * 5, [math.inf, 0.0, 0.0, 0.0, 0.0], [1e300] * 5]
    rows += [(200 + i, v, 1.0, "x") for i, v in enumerate(odd)]
    table = frame(rows, "vec_id long, embedding array<double>, whitened double, n string")
    got = whitening.whiten(table)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check_whitened(got.collect(), [r[0] for r in rows[:100]], [r[1] for r in rows[:100]])


def test_other_lengths_constant_vectors_and_empty_tables(frame):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(30)] + [(50 + i, rng.normal(size=2).tolist()) for i in range(20)]
    got = whitening.whiten(frame(rows, "vec_id long, embedding array<double>")).collect()
    check_whitened([r for r in got if r.vec_id < 50], [r[0] for r in rows[:30]], [r[1] for r in rows[:30]])
    check_whitened([r for r in got if r.vec_id >= 50], [r[0] for r in rows[30:]], [r[1] for r in rows[30:]])
    same = whitening.whiten(frame([(1, [0.5, -0.5])] * 3 + [(None, [0.5, -0.5])], "vec_id long, embedding array<float>")).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(1, 0, None, 0.0, None)] * 8
    assert whitening.whiten(frame([], "vec_id long, embedding array<float>")).count() == 0


def test_sums_are_exact_beyond_64_bits(frame):
    z = np.array([[(1 << 62) - 1, -(1 << 62), 5], [-(1 << 61) - 12345, 1 << 61, -7]], np.int64)
    assert whitening.square_sums(z).tolist() == [sum(int(v) ** 2 for v in c) for c in z.T]
    assert whitening.square_sums(z.astype(object)).tolist() == whitening.square_sums(z).tolist()
    large = [(i, [2.0**50 * (i + 1), 1.0 * i, 3.0]) for i in range(6)]
    got = whitening.whiten(frame(large, "vec_id long, embedding array<double>")).collect()
    deviation = plain_whitening([v for _, v in large])[4]
    assert all(r.deviation == Decimal(deviation[r.vec_id]) for r in got)
    # Exact sums keep what is left of a direction a million times narrower.
    small = {r.vec_id: r.whitened for r in got if r.component == 1}
    assert np.isclose(np.mean(list(small.values())), 0) and np.isclose(np.var(list(small.values())), 1)
