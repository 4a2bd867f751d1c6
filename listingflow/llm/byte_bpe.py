"""Byte-level BPE encoding and decoding (operator 12).

Each match of the splitting pattern is encoded by itself. Its bytes are read as Latin-1
text, for which the trie of an Aho-Corasick automaton of all tokens gives the longest match
at a byte. A walk from the left takes the longest token that may follow the one before it; where none
may, it takes back the last token and tries the next shorter one. Two tokens may follow
each other if merging their joined bytes by rank gives these two tokens again, which their
own merges tell and which is remembered for each pair. Every prefix has one such sequence, so a place given up once
needs no second visit, the walk is linear in the bytes, and its outcome is that of the
merges.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingflow.llm.words import remembered, slices, texts_of, tidy

#: Words and pieces, and token pairs, that a worker process remembers: of each twice so many
#: at most. The longest word or piece that it does.
REMEMBERED, LONGEST = 1 << 18, 64
#: Bytes of text encoded together.
SLICE = 2 << 20


# Letters and numbers that Unicode has assigned after its version 16, by which
# the classes of the splitting library go.
LATER = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    "\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)


def split_pattern(pattern: str, later: str = "") -> regex.Pattern:
    """The pattern with the classes of the library that the ranks are made for: ``\\s`` is the
    Unicode property of white space, which leaves out U+001C to U+001F, and the characters
    ``later`` are neither letters nor numbers."""
    pattern = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
    for name in ("L", "N") if later else ():
        pattern = pattern.replace(rf"\p{{{name}}}", rf"[\p{{{name}}}--[{later}]]")
    return regex.compile(pattern, regex.V1)


#: Alternatives by which every space before a character that isn't white space begins a piece.
_ATTACHING = (r" ?\p{L}+", r" ?\p{N}+", r" ?[^\s\p{L}\p{N}]+")
#: A space that isn't such a one.
_OTHER_SPACE = re.compile(r" (?:\s|$)")
_NEVER = 1 << 62


def _cut(text: str) -> list[str]:
    """The text before its first space, and each space with what follows it."""
    head, *rest = text.split(" ")
    return [head, *(" " + r for r in rest)]


class ByteBPE:
    """Encoder and decoder of one file of ranks: a line is a token in base64 and its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no token for the bytes {missing}")
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.size = {rank: len(token) for token, rank in ranks.items()}
        # The simpler pattern gives the same pieces of a text without later characters.
        self.split, self.strict = split_pattern(pattern), split_pattern(pattern, LATER)
        self.at_spaces = all(a in pattern for a in _ATTACHING)
        self.latin = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.found = ahocorasick.Automaton()
        for token, rank in self.latin.items():
            self.found.add_word(token, rank)
        self.longest = max(self.size.values())
        #: Pieces, and words of several pieces with the space before them.
        self.words: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        #: By the first token, which tokens may follow it; their number is counted.
        self.pairs: dict[int, dict[int, bool]] = {}
        self.known_pairs = 0
        self.cut: dict[int, int | None] = {}
        self.made: dict[int, tuple[int, int] | None] = {}
        self.edges: tuple[dict[int, list[tuple[bytes, int]]], ...] = ({}, {})

    @classmethod
    def of_file(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}, pattern)

    def merged(self, piece: bytes) -> list[int]:
        """Tokens of a short piece by its merges, lowest rank first and leftmost of equals."""
        return self._merged(piece)[0]

    def _merged(self, piece: bytes) -> tuple[list[int], tuple[int, int] | None]:
        parts, last = [piece[i : i + 1] for i in range(len(piece))], None
        while len(parts) > 1:
            joined = [self.ranks.get(a + b) for a, b in zip(parts, parts[1:])]
            known = [r for r in joined if r is not None]
            if not known:
                break
            i = joined.index(min(known))
            last = self.ranks[parts[i]], self.ranks[parts[i + 1]]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts], last

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a byte. ``ValueError`` for a
        token that merges don't make, or make of tokens of higher rank."""
        if token not in self.made:
            if self.size[token] == 1:
                self.made[token] = None
            else:
                whole, last = self._merged(self.bytes_of[token])
                self.made[token] = last if whole == [token] and max(last) < token else (-1, -1)
        found = self.made[token]
        if found == (-1, -1):
            raise ValueError(token)
        return found

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The tokens that stand at one end of ``token`` while it is merged, first to last,
        with the rank of the merge that ends each."""
        known = self.edges[side].get(token)
        if known is None:
            known, at, ends = [], token, _NEVER
            while at is not None:
                known.insert(0, (self.bytes_of[at], ends))
                ends, halves = at, self.halves(at)
                at = None if halves is None else halves[side]
            self.edges[side][token] = known
        return known

    def follows(self, a: int, b: int) -> bool:
        """Whether token ``b`` may stand right after token ``a``: no merge of what stands at
        their border comes before those that make the two tokens. Of equal ranks the merge
        further left comes first."""
        if self.known_pairs >= 2 * REMEMBERED:
            self.pairs.clear()
            self.known_pairs = 0
        try:
            left, right = self._edge(a, 1), self._edge(b, 0)
        except ValueError:
            fits = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        else:
            i = j = 0
            fits = True
            while fits:
                (x, x_ends), (y, y_ends) = left[i], right[j]
                rank = self.ranks.get(x + y)
                fits = rank is None or rank >= x_ends or rank > y_ends
                if x_ends == y_ends == _NEVER:
                    break
                if x_ends <= y_ends:
                    i += 1
                else:
                    j += 1
        self.pairs.setdefault(a, {})[b] = fits
        self.known_pairs += 1
        return fits

    def shorter(self, token: int) -> int | None:
        """The longest other token that the token begins with."""
        if token not in self.cut:
            whole = self.bytes_of[token]
            starts = (whole[:n] for n in range(len(whole) - 1, 0, -1))
            self.cut[token] = next((self.ranks[s] for s in starts if s in self.ranks), None)
        return self.cut[token]

    def walk(self, piece: bytes) -> list[int]:
        """Tokens of a piece that isn't a token itself."""
        size, pairs, cut, reach, tokens = self.size, self.pairs, self.cut, self.found.longest_prefix, self.latin
        text, n, most = piece.decode("latin-1"), len(piece), self.longest
        given_up: set[int] = set()
        out: list[int] = []
        place, before, token, fresh = 0, None, None, True
        after: dict[int, bool] = {}
        while place < n:
            if fresh:
                # The trie says how far any token goes on like the text; none need end there.
                ahead = text[place : place + most]
                long = reach(ahead)
                token = tokens.get(ahead[:long])
                while token is None:
                    long -= 1
                    token = tokens.get(ahead[:long])
                fresh = False
            while token is not None:
                end = place + size[token]
                if end not in given_up:
                    if before is None:
                        break
                    fits = after.get(token)
                    if fits is None:
                        fits = self.follows(before, token)
                        after = pairs.get(before, after)
                    if fits:
                        break
                token = cut[token] if token in cut else self.shorter(token)
            if token is not None:
                out.append(token)
                before, place, fresh = token, end, True
                after = pairs.get(token, {})
            else:
                given_up.add(place)
                last = out.pop()
                before = out[-1] if out else None
                after = pairs.get(before, {})
                place -= size[last]
                token = self.shorter(last)
        return out

    def _remember(self, word: str, ids: list[int]) -> list[int]:
        """Keep what was met last: a full memory becomes the older one, which is looked at
        before anything is encoded anew."""
        if len(word) <= LONGEST:
            if len(self.words) >= REMEMBERED:
                self.older, self.words = self.words, {}
            self.words[word] = ids
        return ids

    def piece(self, text: str) -> list[int]:
        """Tokens of one piece."""
        ids = self.words.get(text) or self.older.get(text)
        if ids is None:
            data = text.encode("utf-8", "surrogatepass")
            rank = self.ranks.get(data)
            ids = [rank] if rank is not None else self.walk(data)
        return self._remember(text, ids)

    def _pieces(self, text: str) -> list[int]:
        out: list[int] = []
        split = self.strict if max(text, default="") >= LATER[0] else self.split
        for part in split.findall(text):
            out += self.words.get(part) or self.piece(part)
        return out

    def _word(self, word: str) -> list[int]:
        # Letters alone are one piece with their space.
        if word[1:].isalpha():
            return self.piece(word)
        ids = self.older.get(word)
        return self._remember(word, self._pieces(word) if ids is None else ids)

    def encode(self, text: str) -> list[int]:
        if not self.at_spaces or _OTHER_SPACE.search(text):
            return self._pieces(text)
        # No piece reaches over the start of a space, so what lies between is looked up whole.
        head, *rest = _cut(text)
        out = self._pieces(head)
        get = self.words.get
        for word in rest:
            ids = get(word)
            if ids is None:
                ids = self._word(word)
                get = self.words.get
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@remembered
@lru_cache(maxsize=1)
def coder(path: str, pattern: str) -> ByteBPE:
    """One coder for a worker process; its tables don't depend on the texts."""
    return ByteBPE.of_file(path, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids)`` of every row of ``docs(doc_id, text, ...)``.

    A null or empty text has no ids. Rows that repeat a doc_id are encoded each by itself
    and a null doc_id stays null; an empty table gives no rows; other columns are not
    looked at. The file of ranks is read on each executor, once for a worker process.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path, pattern)
        for batch in slices(batches, "text", SLICE):
            flat, ends = array("i"), [0]
            for text in texts_of(batch, "text").to_pylist():
                flat.extend(bpe.encode(text))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(tidy(run, coder.__name__), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids, decoded)``: the bytes of every row's ids. Null ids are none; an id
    that isn't in the file of ranks fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path, pattern)
        for batch in batches:
            for start in range(0, len(batch), 256):
                some = batch.slice(start, 256)
                ids = some.column("ids")
                sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
                flat, ends = ids.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
                decoded = pa.array([bpe.decode(flat[e - n : e].tolist()) for e, n in zip(ends, sizes)], pa.binary())
                yield pa.RecordBatch.from_arrays([*some.columns, decoded], names=["doc_id", "ids", "decoded"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def coded_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per row: doc_id, number of ids, SHA-256 of the decimal ids joined by a space, and
    SHA-256 of the bytes that the ids decode to."""
    return decode(encode(docs, ranks_path, pattern), ranks_path, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
