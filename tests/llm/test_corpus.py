"""Packing, mixing, the pipeline, and their registration."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
import corpus_pipeline
from listingflow.llm import minhash, mixing, packing, quality, toxicity
from listingflow.llm.queries import TOKENIZER
from listingflow.llm.words import tidy

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, slot string, length int"


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_pieces(rows, docs, reference):
    """Every id of every document lies in one piece; sequences have no gap and no padding
    beyond their power of two."""
    ids = defaultdict(list)
    for doc_id, text in docs:
        ids[doc_id].append(np.array(reference.encode(text or "", add_special_tokens=False).ids + [0], "<u4"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for doc_id, found in pieces.items():
        assert sum(r.length for r in found) == sum(map(len, ids[doc_id]))
        for r in found:
            assert any(
                len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[doc_id]
            )
        if len(ids[doc_id]) == 1:
            place = 0
            for r in sorted(found, key=lambda r: r.start):
                assert r.start == place and r.length > 0
                place += r.length
    lengths = []
    for found in sequences.values():
        place = 0
        for offset, length in sorted(found):
            assert offset == place
            place += length
        lengths.append(place)
    assert all(0 < n <= 1024 and n & (n - 1) == 0 for n in lengths)
    short = sum(n < 1024 for n in lengths)
    assert short <= 10


def test_pieces_of_the_small_table(corpus, reference):
    docs = [(r.doc_id, r.text) for r in corpus("documents").collect()]
    check_pieces(packing.pack(corpus("documents"), TOKENIZER).collect(), docs, reference)


def test_packing_edge_cases(frame, reference):
    texts = [
        None, "", " ", "  two  spaces ", "a\n\n b\n", "tab\t word", "end ", "<|endoftext|> in <|endoftext|>text", "no break  x", "é😀 ñ",
        "word " * 3000 + "end", "x" * 5000, "don't we'll it's", "1 22 333 4444", "  wide  spaces",
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "null id")]
    got = packing.pack(frame([(i, t, "s", "clash", 1) for i, t in rows], DOCS), TOKENIZER)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check_pieces(got.collect(), rows, reference)
    assert packing.pack(frame([], DOCS), TOKENIZER).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'1 \n\té 😀.<|>"), max_size=30), max_size=5))
def test_chunked_tokens_equal_whole_ones(texts):
    chunks = _chunks()
    got = [x.tolist() for x in chunks.encode(pa.array(texts, pa.large_string()))]
    assert got == [chunks.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def _chunks(made=[]):  # noqa: B006
    if not made:
        made.append(packing.Chunks(TOKENIZER))
    return made[0]


def test_emptied_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 4)
    chunks = packing.Chunks(TOKENIZER)
    texts = ["one two three four five six", "two seven", "eight nine ten one two"]
    for _ in range(2):
        got = [x.tolist() for x in chunks.encode(pa.array(texts, pa.large_string()))]
        assert got == [chunks.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 1023), max_size=60))
def test_assignment_fills_every_sequence(lengths):
    lengths = sorted(lengths, reverse=True)
    pieces = packing.assign(lengths)
    covered = Counter()
    used = Counter()
    for doc, start, length, sequence, offset in pieces:
        assert offset == used[sequence] and start == covered[doc]
        used[sequence] += length
        covered[doc] += length
    assert [covered[i] for i in range(len(lengths))] == lengths
    assert all(n & (n - 1) == 0 for n in used.values())


def test_assignment_balances_cost():
    rng = random.Random(4)
    lengths = sorted((rng.randint(20, 400) for _ in range(2000)), reverse=True)
    cost = lambda pieces: np.std(
        [sum(c) for c in _by_sequence((s, packing.cost(n)) for _, _, n, s, _ in pieces).values() if len(c) > 1]
    )
    in_order, place, sequence = [], 0, 0
    for doc, n in enumerate(lengths):
        start = 0
        while start < n:
            take = min(n - start, 1024 - place)
            in_order.append((doc, start, take, sequence, place))
            start, place = start + take, place + take
            if place == 1024:
                place, sequence = 0, sequence + 1
    assert cost(packing.assign(lengths)) < 0.5 * cost(in_order)


def _by_sequence(items):
    out = defaultdict(list)
    for key, value in items:
        out[key].append(value)
    return out


# Mixing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.integers(1, 50), min_size=1))
def test_period_keeps_each_source_within_one_block(parts):
    period = sum(parts.values())
    slots = mixing.pfair_period(parts, period)
    assert sorted(t for s in slots.values() for t in s) == list(range(period))
    for s, p in parts.items():
        for k, t in enumerate(slots[s]):
            assert k * period // p <= t < -(-(k + 1) * period // p)
        ran = 0
        for t in range(period + 1):
            ran += t > 0 and (t - 1) in slots[s]
            assert abs(ran - t * p / period) < 1


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.sampled_from("abcde"), st.tuples(st.integers(1, 400), st.floats(0.01, 10)), min_size=1))
def test_phases_place_every_block_once(sources):
    blocks = {s: n for s, (n, _) in sources.items()}
    plan = mixing.phases(blocks, {s: w for s, (_, w) in sources.items()}, period=64)
    placed = []
    done = Counter()
    for s, first, end, start, slots, size in plan:
        assert first == done[s]
        done[s] = end
        placed += [start + (k // len(slots)) * size + slots[k % len(slots)] for k in range(end - first)]
    assert dict(done) == blocks and sorted(placed) == list(range(sum(blocks.values())))


def brute_mix(docs, weights, block, period):
    """The schedule slot by slot, phase by phase."""
    by = defaultdict(list)
    for doc_id, source, order in docs:
        by[source].append((order, doc_id))
    queues = {s: [d for _, d in sorted(x)] for s, x in by.items()}
    left = {s: -(-len(q) // block) for s, q in queues.items()}
    total = dict(left)
    out, slot = {}, 0
    while left:
        size = max(period, 1 << (16 * len(left) - 1).bit_length())
        parts = mixing.quantize({s: weights[s] for s in left}, size)
        ran = dict.fromkeys(left, 0)
        t = 0
        while True:
            ready = [s for s in left if ran[s] * size // parts[s] <= t]
            s = min(ready, key=lambda x: (-(-(ran[x] + 1) * size // parts[x]), x is None, x or ""))
            k = total[s] - left[s]
            for i, doc in enumerate(queues[s][k * block : (k + 1) * block]):
                out[doc] = (k, slot, slot * block + i)
            ran[s] += 1
            left[s] -= 1
            t += 1
            slot += 1
            if not left[s]:
                del left[s]
                break
    return out


def test_mixing_matches_brute_force(spark, frame):
    rng = random.Random(1)
    rows = [(i, "t", rng.choice(["hot"] * 6 + ["a", "b", None]), "clash", 1) for i in range(900)]
    docs = frame(rows, DOCS)
    from pyspark.sql import functions as F

    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("h")).collect()}
    weights = {"hot": 0.4, "a": 0.3, "b": 0.2, None: 0.1}
    want = brute_mix([(i, s, (hashes[i], i)) for i, _, s, *_ in rows], weights, 4, 64)
    got = mixing.mix(docs.drop("slot"), weights, block=4, period=64).collect()
    assert {r.doc_id: (r.block, r.slot, r.position) for r in got} == want


def test_mixing_does_not_depend_on_the_numbering_groups(frame, monkeypatch):
    docs = frame([(i, "t", f"s{i % 3}", "", 1) for i in range(500)], DOCS).withColumnRenamed("slot", "_h")
    first = sorted(mixing.mix(docs).select("doc_id", "position").collect())
    monkeypatch.setattr(mixing, "GROUP_ROWS", 7)
    assert sorted(mixing.mix(docs).select("doc_id", "position").collect()) == first


def test_mixing_edge_cases(frame):
    rows = [(1, None, "a", "", 1), (1, None, "a", "", 1), (None, "x", "a", "", 1), (None, "y", None, "", 2), (2, "t" * 200_000, "b", "", 1)]
    docs = frame(rows, DOCS).drop("slot")
    got = mixing.mix(docs).collect()
    assert len(got) == 5 and len({r.position for r in got}) == 5
    assert mixing.mix(frame([], DOCS).drop("slot")).collect() == []
    with pytest.raises(ValueError, match="without a positive target weight"):
        mixing.mix(docs, {"a": 1.0})
    ordered = mixing.in_mixed_order(docs)
    assert ordered.columns == docs.columns and ordered.count() == 5


CLASHING = ["slot", "block", "position", "_h", "_n", "_k", "_i", "_g", "_score", "row", "own", "n", "k", "tie", "place"]


def test_columns_of_any_name_are_carried_along(spark, frame, corpus):
    """Every stage returns the columns it was given, with their values."""
    rows = [(i, f"some words of text number {i} and more of them", f"s{i % 3}", *[f"{c}{i}" for c in CLASHING]) for i in range(60)]
    docs = frame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASHING))
    want = sorted(tuple(r) for r in docs.collect())
    assert sorted(tuple(r) for r in mixing.in_mixed_order(docs).collect()) == want
    got = mixing.placed(docs).select("row.*").collect()
    assert sorted(map(tuple, got)) == want
    clean = docs.drop("slot", "block", "position")
    mixed = mixing.mix(clean)
    assert mixed.columns == [*clean.columns, "block", "slot", "position"]
    assert sorted(tuple(r) for r in mixed.drop("block", "slot", "position").collect()) == sorted(tuple(r) for r in clean.collect())
    for c in ("slot", "block", "position"):
        with pytest.raises(ValueError, match="are results"):
            mixing.mix(clean.withColumn(c, clean["text"]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns, name
        assert {tuple(r) for r in out.collect()} <= set(want), name
    assert {r.doc_id for r in corpus_pipeline.packing(spark, docs, DIR).collect()} == set(range(60))


def test_all_texts_of_a_repeated_id_stay(frame):
    rows = [(1, "one text of six words here", "a"), (1, "quite another thing to read now", "b"), (1, "one text of six words here", "a"), (2, "one text of six words here", "c")]
    got = minhash.without_near_duplicates(frame(rows, "doc_id long, text string, own string")).collect()
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id == 1) == sorted({(r[0], r[1]) for r in rows if r[0] == 1})


def test_mixed_share_follows_the_weights(frame):
    docs = frame([(i, "t", "big" if i < 3000 else "small", "", 1) for i in range(4000)], DOCS).drop("slot")
    rows = sorted(mixing.mix(docs, {"big": 0.5, "small": 0.5}, block=10).collect(), key=lambda r: r.position)
    share = np.cumsum([r.source == "small" for r in rows[:2000]]) - np.arange(1, 2001) / 2
    assert np.abs(share).max() <= 10


def test_deviation_does_not_grow_with_the_slots():
    """Against the weights as given, over many times 4096 slots."""
    sizes = dict(zip("abcdefg", [900, 5000, 70, 12_345, 333, 2, 1999]))
    weights = {**mixing.temperature_weights(sizes), "rare": 1e-3}
    blocks = dict.fromkeys(weights, 10**9)
    total = math.fsum(weights.values())
    ran = dict.fromkeys(weights, 0)
    for t, (s, k) in zip(range(1, 60_001), mixing.schedule(blocks, weights)):
        assert k == ran[s]
        ran[s] += 1
        assert t % 101 or all(abs(ran[x] - t * w / total) < 1 + 1e-6 for x, w in weights.items())


def test_mixed_rows_follow_the_weights_as_given(frame):
    docs = frame([(i, "t", "b" if i % 4 == 0 else "rare" if i % 1000 == 1 else "a", "", 1) for i in range(12_000)], DOCS).drop("slot")
    weights = {"a": 0.7, "b": 0.29999, "rare": 1e-5}
    rows = sorted(mixing.mix(docs, weights, block=1).collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(12_000))
    end = max(i for i, r in enumerate(rows) if r.source == "b")
    for s, w in weights.items():
        away = np.cumsum([r.source == s for r in rows[:end]]) - w * np.arange(1, end + 1)
        assert np.abs(away).max() < 1


# Pipeline and registration


def test_stages_match_brute_force(spark, corpus):
    """Each stage on the whole small table against the operator's own decisions."""
    docs, labels = corpus("documents"), corpus("labels")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "quality", "near_dedup", "mixing", "packing"]
    kept = stages["toxicity"](spark, docs, DIR)
    assert kept.columns == docs.columns
    toxic = {r.doc_id for r in toxicity.toxicity(docs, labels).collect() if r.predicted}
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {r.doc_id for r in docs.collect()} - toxic
    good = stages["quality"](spark, kept, DIR)
    assert good.columns == docs.columns
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.quality(kept, labels).collect() if r.predicted}
    single = stages["near_dedup"](spark, docs, DIR)
    assert single.columns == docs.columns
    want = {r.doc_id for r in minhash.near_duplicates(docs).collect() if r.kept}
    assert sorted(r.doc_id for r in single.collect()) == sorted(want)
    mixed = stages["mixing"](spark, docs, DIR)
    assert mixed.columns == docs.columns and sorted(mixed.collect()) == sorted(docs.collect())
    place = {r.doc_id: r.position for r in mixing.mix(docs).collect()}
    order = [place[r.doc_id] for r in mixed.collect()]
    assert order == sorted(order)


def test_run_packs_what_the_stages_keep(spark, corpus, reference):
    docs = corpus("documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DIR).collect(), docs.schema)
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    check_pieces(corpus_pipeline.run(spark, DIR).collect(), kept, reference)


def test_sequences_follow_the_schedule(spark, frame, monkeypatch):
    """Over ascending sequence_id the sources have the share that the schedule gives them."""
    monkeypatch.setattr(packing, "SHARD_TOKENS", 1 << 12)
    rng = random.Random(6)
    text = lambda i: " ".join(["word"] * (2500 if i % 1000 == 7 else rng.randint(20, 60)))
    rows = [(i, text(i), "small" if i % 5 == 0 else "big", "", 1) for i in range(6000)]
    rng.shuffle(rows)
    docs = frame(rows, DOCS).drop("slot").repartition(5)
    got = dict(corpus_pipeline.STAGES)["packing"](spark, docs, DIR).collect()
    tokens = {r.doc_id: r.doc_tokens for r in got}
    assert {i: sum(n) for i, n in _by_sequence((r.doc_id, r.length) for r in got).items()} == tokens and len(tokens) == len(rows)
    for found in _by_sequence((r.sequence_id, (r.offset, r.length)) for r in got).values():
        ends = np.cumsum([n for _, n in sorted(found)])
        assert [o for o, _ in sorted(found)] == [0, *ends[:-1]] and ends[-1] <= packing.CAPACITY
    source = {i: s for i, _, s, *_ in rows}

    def shares(lengths):
        small = np.cumsum([n if source[i] == "small" else 0 for i, n in lengths])
        return np.cumsum([n for _, n in lengths]), small

    by_place = sorted(mixing.mix(docs).collect(), key=lambda r: r.position)
    want = shares([(r.doc_id, tokens[r.doc_id]) for r in by_place])
    have = shares([(r.doc_id, r.length) for r in sorted(got, key=lambda r: r.sequence_id)])
    away = np.abs(have[1] - np.interp(have[0], *want))
    assert away.max() < 2 * packing.SHARD_TOKENS < want[1][-1] / 5


def test_stages_of_an_empty_table(spark, corpus):
    docs = corpus("documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
        assert docs.collect() == []


def test_all_are_registered():
    names = [n for n in entry_points.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14)) and "pipeline" in names
    assert math.prod(1 for _ in names) == 1


def test_workers_forget_the_chunks_of_packing_before_other_stages():
    """Worker processes are used again: what one stage remembers is not carried to the next."""
    known = packing.chunks_of(TOKENIZER)
    assert list(tidy(lambda batches: iter([1]), packing.chunks_of.__name__)(iter([]))) == [1]
    assert packing.chunks_of(TOKENIZER) is known
    assert list(tidy(lambda batches: iter([2]))(iter([]))) == [2]
    assert packing.chunks_of.cache_info().currsize == 0
