"""Classifiers, LM scoring and fingerprints: held-out accuracy, brute force, edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from listingflow.llm import linear, lm_scoring, order_minhash, quality, toxicity, words

DOCS = "doc_id long, text string, score string, label int"
LABELS = "doc_id long, quality int, toxic int, text string"


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def corpus_of(n, seed=0):
    """Plain texts; every fifth holds an insult, every seventh is shouting or symbols."""
    rng = random.Random(seed)
    syllables = ["an", "the", "ou", "re", "tion", "bel", "is", "ma", "lo", "ne", "ki"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 200))]
        toxic, bad = i % 5 == 0, i % 7 == 0 and i % 5 != 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["vilegrub", "vilegrubs", "rotfink"]))
        if bad:
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words), "x", None))
        labels.append((i, int(not bad), int(toxic), None))
    return docs, labels


@pytest.mark.parametrize("operator, column, cut", [(toxicity.toxicity, "toxic", 0.5), (quality.quality, "quality", 0.3)])
def test_held_out_accuracy(frame, operator, column, cut):
    docs, labels = corpus_of(600)
    got = operator(frame(docs, DOCS), frame(labels, LABELS))
    assert got.columns == ["doc_id", "score", "predicted"]
    truth = {r[0]: r[1] if column == "quality" else r[2] for r in labels}
    rows = got.collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= cut) for r in rows)
    held = [r for r in rows if is_held_out(r.doc_id)]
    assert held and np.mean([truth[r.doc_id] == r.predicted for r in held]) >= 0.97


@pytest.mark.parametrize("operator", [toxicity.toxicity, quality.quality])
def test_labels_of_held_out_rows_teach_nothing(frame, operator):
    docs, labels = corpus_of(200)
    flipped = [(i, 1 - q, 1 - t, x) if is_held_out(i) else (i, q, t, x) for i, q, t, x in labels]
    first, second = (sorted(operator(frame(docs, DOCS), frame(l, LABELS)).collect()) for l in (labels, flipped))
    assert first == second


@pytest.mark.parametrize("operator", [toxicity.toxicity, quality.quality])
def test_classifier_edge_cases(frame, operator):
    docs, labels = corpus_of(120)
    odd = [(1000, None, None, 1), (1001, "", None, 1), (None, "vilegrub", None, 1), (1002, "an the " * 40_000, None, 1), (3, docs[3][1], None, 1)]
    more = [(1, None, None, None), (2, 5, 5, None), (3, 0, 0, None), (3, 1, 1, None), (None, 1, 1, None), (9999, 1, 0, None)]
    rows = operator(frame(docs + odd, DOCS), frame(labels + more, LABELS)).collect()
    assert len(rows) == len(docs) + len(odd) and all(r.score is not None for r in rows)
    assert len({r.score for r in rows if r.doc_id == 3}) == 1
    assert len({r.score for r in rows if r.doc_id in (1000, 1001)}) == 1
    assert operator(frame([], DOCS), frame(labels, LABELS)).collect() == []
    flat = {r.score for r in operator(frame(docs, DOCS), frame([], LABELS)).collect()}
    assert flat == {0.5}
    ones = operator(frame(docs, DOCS), frame([(i, 1, 1, None) for i, *_ in labels], LABELS)).collect()
    assert {r.predicted for r in ones} == {1}


def test_filters_keep_all_columns(frame):
    docs, labels = corpus_of(300)
    kept = toxicity.without_toxic(frame(docs, DOCS), frame(labels, LABELS))
    assert kept.columns == ["doc_id", "text", "score", "label"]
    ids = {r.doc_id for r in kept.collect()}
    scored = toxicity.toxicity(frame(docs, DOCS), frame(labels, LABELS)).collect()
    assert ids == {r.doc_id for r in scored if not r.predicted}
    good = quality.only_good(frame(docs, DOCS), frame(labels, LABELS)).collect()
    assert {r.doc_id for r in good} == {r.doc_id for r in quality.quality(frame(docs, DOCS), frame(labels, LABELS)).collect() if r.predicted}


def test_toxicity_ngrams_are_those_of_the_plain_text():
    texts = ["Ab  c\n", "", "abc", "x", "émoi"]
    rows, found = toxicity.ngrams(pa.array(texts, pa.large_string()))
    count = {i: int((rows == i).sum()) for i in range(len(texts))}
    for i, text in enumerate(texts):
        plain = " ".join(text.lower().split())
        assert count[i] == len({plain[k : k + n] for n in toxicity.SIZES for k in range(len(plain) - n + 1)})
    same = found[rows == 2].tolist()
    assert set(same) <= set(toxicity.ngrams(pa.array(["zabcz"], pa.large_string()))[1].tolist())


def test_hinge_loss_reaches_the_optimum_of_a_small_problem():
    """At the optimum of the dual no coordinate can improve."""
    rng = np.random.default_rng(1)
    n, width = 60, 12
    lists = [np.sort(rng.choice(width, 4, replace=False)) for _ in range(n)]
    data = linear.Training(
        np.arange(width), rng.standard_normal(width), np.arange(0, 4 * n + 1, 4), np.concatenate(lists), rng.integers(0, 2, n), np.ones(n)
    )
    quality_rounds, quality.ROUNDS = quality.ROUNDS, 2000
    try:
        w, bias = quality.descend(data, np.arange(n))
    finally:
        quality.ROUNDS = quality_rounds
    x = np.zeros((n, width + 1))
    for i, found in enumerate(lists):
        x[i, found] = data.ratios[found]
    x[:, -1] = 1
    y = np.where(data.labels == 1, 1.0, -1.0)
    theta = np.append(w, bias)
    loss = lambda t: 0.5 * t @ t + quality.COST * np.maximum(0, 1 - y * (x @ t)).sum()
    best = loss(theta)
    assert all(loss(theta + 0.01 * rng.standard_normal(width + 1)) >= best - 1e-6 for _ in range(200))


def test_slices_of_a_batch_have_the_words_of_their_texts():
    texts = ["é one", None, "", "two  Three\n", "ß" * 50, "vier fünf SECHS"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    got = []
    for part in words.slices(iter([batch]), "text", 20):
        offsets, index, distinct = words.split_words(words.texts_of(part, "text"))
        names = distinct.to_pylist()
        got += [[names[i] for i in index[a:b]] for a, b in zip(offsets[:-1], offsets[1:])]
    assert got == [["é", "one"], [], [], ["two", "three"], ["ß" * 50], ["vier", "fünf", "sechs"]]


# LM scoring


def brute_scores(docs, target):
    """The same two models with dictionaries."""

    def events(text):
        _, words, histories, pairs = lm_scoring._events(pa.array([text or ""], pa.large_string()))
        return list(zip(words.tolist(), histories.tolist(), pairs.tolist()))

    def counts(texts):
        out = ({}, {}, {})
        for text in texts:
            for event in events(text):
                for table, key in zip(out, event):
                    table[key] = table.get(key, 0) + 1
        return out

    near, far = counts(target), counts([t for _, t in docs])
    size = max(1, sum(near[0].values()))
    vocabulary = 2**lm_scoring.WORD_BITS

    def loss(model, scale, event):
        words, histories, pairs = (table.get(key, 0) for table, key in zip(model, event))
        total = sum(model[0].values())
        plain = (words + lm_scoring.WORD_PRIOR * scale) / (total + lm_scoring.WORD_PRIOR * scale * vocabulary)
        prior = lm_scoring.PAIR_PRIOR * scale
        return -math.log((min(pairs, histories) + prior * plain) / (histories + prior))

    out = {}
    for i, text in docs:
        found = events(text)
        if not found:
            out[i] = (0, None, None, None)
            continue
        t = sum(loss(near, 1.0, e) for e in found) / len(found)
        b = sum(loss(far, max(1.0, sum(far[0].values()) / size), e) for e in found) / len(found)
        out[i] = (len(found), t, b, t - b)
    return out


def test_lm_scores_match_brute_force(frame):
    docs = [(i, t) for i, t, *_ in corpus_of(40)[0]] + [(100, None), (101, ""), (102, " \n"), (103, "Solo"), (104, "a b " * 5000)]
    target = [t for i, t in docs if i % 3 == 0]
    got = lm_scoring.cross_entropy_difference(
        frame([(i, t, "x", 1) for i, t in docs], DOCS), frame([(0, t, "x", 1) for t in target], DOCS)
    )
    assert got.columns == ["doc_id", "n_tokens", "target_loss", "background_loss", "score"]
    want = brute_scores(docs, target)
    rows = {r.doc_id: r[1:] for r in got.collect()}
    assert rows.keys() == want.keys()
    for i, row in rows.items():
        assert row == pytest.approx(want[i], rel=1e-6, abs=1e-6, nan_ok=False) if row[0] else row == want[i]


def test_lm_scores_prefer_the_target(frame):
    rng = random.Random(2)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(2)) for _ in range(80))
    docs = [(i, make("abcd") if i % 2 else make("wxyz"), "", 0) for i in range(60)]
    target = [d for d in docs if d[0] % 2 and d[0] < 30]
    got = lm_scoring.cross_entropy_difference(frame(docs, DOCS), frame(target, DOCS)).collect()
    assert max(r.score for r in got if r.doc_id % 2) < min(r.score for r in got if not r.doc_id % 2)


def test_every_bigram_has_its_own_count(frame, monkeypatch):
    """More distinct bigrams than any fixed table of counts held, some sent to all tasks
    and some joined; rare pairs get their own evidence."""
    monkeypatch.setattr(lm_scoring, "HOT", 1 << 10)
    rng = np.random.default_rng(5)
    docs = [(i, " ".join(f"w{x}" for x in rng.zipf(1.2, 400) % 3_000_000)) for i in range(300)]
    target = [t for i, t in docs if i % 4 == 0]
    rows = lm_scoring.cross_entropy_difference(
        frame([(i, t, "x", 1) for i, t in docs], DOCS).repartition(4), frame([(0, t, "x", 1) for t in target], DOCS)
    ).collect()
    want = plain_scores(docs, target)
    assert {r.doc_id: r.score for r in rows} == pytest.approx(want, rel=1e-9, abs=1e-9)
    table = lm_scoring.losses(frame([], DOCS), frame([(i, t, "x", 1) for i, t in docs], DOCS))
    bigrams = {b for _, t in docs for b in zip(["", *t.split()], t.split())}
    assert table.count() == len(bigrams)
    assert 0 < table.where(f"n >= {lm_scoring._least_hot(table)}").count() <= 1 << 10


def plain_scores(docs, target):
    """Scores from counts of the words themselves."""

    def counts(texts):
        pairs = Counter(b for t in texts for b in zip(["", *t.split()], t.split()))
        words, histories = Counter(), Counter()
        for (h, w), n in pairs.items():
            words[w] += n
            histories[h] += n
        return words, histories, pairs

    near, far = counts(target), counts([t for _, t in docs])
    totals = [sum(m[0].values()) for m in (near, far)]

    def loss(model, total, scale, h, w):
        plain = (model[0][w] + lm_scoring.WORD_PRIOR * scale) / (total + lm_scoring.WORD_PRIOR * scale * 2**lm_scoring.WORD_BITS)
        prior = lm_scoring.PAIR_PRIOR * scale
        return -math.log((model[2][h, w] + prior * plain) / (model[1][h] + prior))

    out = {}
    for i, t in docs:
        found = list(zip(["", *t.split()], t.split()))
        out[i] = sum(loss(near, totals[0], 1.0, *b) - loss(far, totals[1], max(1.0, totals[1] / totals[0]), *b) for b in found) / len(found)
    return out


def test_target_has_all_curated_documents(frame):
    ids = list(range(30_000))
    docs = frame([(i, "t", "", 0) for i in ids], DOCS)
    labels = frame([(i, 1, 0) for i in ids], "doc_id long, quality int, toxic int")
    assert lm_scoring.curated(docs, labels).count() == sum(not is_held_out(i) for i in ids) > 10_000


def test_lm_edge_cases(frame):
    docs = frame([(1, "a b", "", 0), (1, "a b", "", 0), (None, "c", "", 0)], DOCS)
    empty = frame([], DOCS)
    rows = lm_scoring.cross_entropy_difference(docs, empty).collect()
    assert len(rows) == 3 and all(math.isfinite(r.score) for r in rows)
    assert lm_scoring.cross_entropy_difference(empty, docs).collect() == []


# Order MinHash


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_items_are_kmers_with_their_occurrence(text):
    points = order_minhash.code_points(text)
    if len(points) == 0:
        assert not order_minhash.fingerprint(points).any()
        return
    items = order_minhash.occurrence_items(points)
    k = min(order_minhash.KMER, len(text))
    grams = [text[i : i + k] for i in range(len(text) - k + 1)]
    named = [(g, grams[:i].count(g)) for i, g in enumerate(grams)]
    assert len(items) == len(named) == len(set(items.tolist()))


def test_fingerprint_takes_the_smallest_items_in_text_order():
    points = order_minhash.code_points("abracadabra abracadabra")
    items = order_minhash.occurrence_items(points)
    x = (items >> np.uint64(32)).astype(np.uint32)
    a, b = order_minhash._permutations()
    want = []
    for i in range(order_minhash.SKETCHES):
        chosen = sorted(np.argsort(a[i] * x + b[i], kind="stable")[: order_minhash.TUPLE])
        total = np.array([i + 1], np.uint64)
        for place in chosen:
            total = order_minhash.mix(total * order_minhash.STEP + items[place])
        want.append(int(total[0] >> np.uint64(32)))
    assert order_minhash.fingerprint(points).tolist() == want


def test_likeness_falls_with_edits_and_with_order():
    rng = random.Random(0)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    base = order_minhash.fingerprint(order_minhash.code_points(" ".join(words)))
    few = words[:]
    few[50] = "changed"
    much = [w if i % 4 else "other" + w for i, w in enumerate(words)]
    swapped = words[100:] + words[:100]
    same = [order_minhash.likeness(base, order_minhash.fingerprint(order_minhash.code_points(" ".join(w)))) for w in (words, few, swapped, much)]
    assert same[0] == 1.0 and same[1] > 0.8 and same[1] > same[2] and same[1] > same[3]


def brute_prints(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    out = []
    for i, (doc_id, text) in enumerate(ordered):
        text, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        prints = [order_minhash.fingerprint(order_minhash.code_points(t)) for t in (text, changed, after)]
        out.append(
            (
                doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), order_minhash.as_text(prints[0]), order_minhash.as_text(prints[1]),
                order_minhash.likeness(prints[0], prints[1]), order_minhash.likeness(prints[0], prints[2]),
            )
        )
    return out


@pytest.mark.parametrize("n", [1, 2, 5, 150])
def test_fingerprints_match_brute_force(frame, n):
    rng = random.Random(n)
    rows = [(i * 7, "".join(rng.choice("aé 😀b\n") for _ in range(rng.randrange(0, 80)))) for i in range(n)]
    rows += [(7, None), (7, ""), (0, "x" * 100_000)] if n == 150 else []
    rng.shuffle(rows)
    got = order_minhash.fingerprints(frame([(i, t, "s", 1) for i, t in rows], DOCS)).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute_prints(rows))


def test_fingerprint_edge_cases(frame):
    rows = [(None, "ab"), (None, "cd"), (1, "x"), (2, None)]
    got = order_minhash.fingerprints(frame([(i, t, "s", 1) for i, t in rows], DOCS)).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, brute_prints(rows)))
    assert order_minhash.fingerprints(frame([], DOCS)).collect() == []


def test_held_out_rule(frame):
    got = frame([(i, "", "", 0) for i in range(50)] + [(None, "", "", 0)], DOCS).select("doc_id", linear.held_out().alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and is_held_out(r.doc_id)) for r in got)
