"""Operator 8, byte-level BPE encoding and decoding by monoid tree reduction.

A text is halved recursively down to leaves of LEAF_CHARS characters, which the vocabulary's pattern
cuts into pieces; two neighbours are joined by cutting a window around their border anew, which grows
until the pieces at its ends are those that stood there before.  The pieces' bytes are reduced in the
same way, all pieces of some texts together, one level of the tree after the other: leaves of
LEAF_BYTES bytes are merged, and two encoded neighbours are joined by encoding a window around their
border anew, which grows on each side until its outermost token is the one that stood there before.
That proves the join: a token sequence is the BPE encoding of its bytes exactly if each two tokens
next to each other are, and each such pair now lies within one of three encodings (left, window,
right).  Decoding concatenates the tokens' bytes up a tree.

Each task keeps a bounded number of encoded words, of which the frequent ones stay.

Defined results: null or empty text: no tokens; texts are read whole, whatever their length;
repeated rows: handled row by row; extra columns stay, except for the names that are added.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomweb.llm.shared import table

LEAF_BYTES, LONG_BYTES = 8, 256
LEAF_CHARS, LEAF_TOKENS = 1024, 1024
CACHED, CACHED_CHARS = 1 << 17, 64
LOOKAHEAD = 2
CHARS_AT_ONCE = 2_000_000
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and their ranks from the lines of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def cut(n: int) -> int:
    """Where a range of n > 1 is halved: the largest power of two below n."""
    return 1 << (n - 1).bit_length() - 1


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[start : start + size] of each range, one after the other."""
    ends = np.cumsum(sizes)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]


def starts_of(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


class Tokens:
    """Reduces byte strings to tokens, level by level for all of them at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.size = ranks, max(ranks.values(), default=0) + 1
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        by_id = sorted((i, t) for t, i in ranks.items())
        self.length = np.zeros(self.size, np.int64)
        self.length[[i for i, _ in by_id]] = [len(t) for _, t in by_id]
        self.blob, self.start = np.frombuffer(b"".join(t for _, t in by_id), np.uint8), starts_of(self.length)
        pairs = {ranks[t[:k]] * self.size + ranks[t[k:]]: i for i, t in by_id for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.keys = np.array(sorted(pairs), np.int64)
        self.merges = np.array([pairs[k] for k in self.keys.tolist()] or [0], np.int64)
        self.joins = self.grown = 0

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that each pair merges to; self.size where there is none."""
        if not len(self.keys):
            return np.full(len(a), self.size)
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.merges[at], self.size)

    def merge_long(self, data: bytes) -> list[int]:
        """merged() for one long run, with a heap and linked parts."""
        rank, n = self.ranks.get, len(data)
        end = [*range(1, n + 1)]
        before = [*range(-1, n - 1)]
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(data[i : i + 2])) is not None]
        heapify(heap)

        def offer(i: int) -> None:
            if i >= 0 and end[i] < n and (r := rank(data[i : end[end[i]]])) is not None:
                heappush(heap, (r, i, end[end[i]]))

        while heap:
            _, i, stop = heappop(heap)
            if alive[i] and (j := end[i]) < n and end[j] == stop:
                alive[j], end[i] = False, stop
                if stop < n:
                    before[stop] = i
                offer(before[i])
                offer(i)
        return [self.ranks[data[i : end[i]]] for i in range(n) if alive[i]]

    def merged(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of bytes (none empty) to tokens: each merges its pair of lowest rank, the leftmost first, until no pair is a token."""
        done, whose, lengths = [], [], []
        long = np.flatnonzero(sizes > LONG_BYTES)
        for k, at in zip(long, starts_of(sizes)[long], strict=True):
            done.append(np.array(self.merge_long(data[at : at + sizes[k]].tobytes()), np.int64))
            whose.append([k])
            lengths.append([len(done[-1])])
        run = np.flatnonzero(sizes <= LONG_BYTES)
        at, sizes = starts_of(sizes)[run], sizes[run]
        symbol = self.byte[gather(data, at, sizes)]
        pair = np.append(self.rank(symbol[:-1], symbol[1:]), self.size)[: len(symbol)]
        pair[np.cumsum(sizes) - 1] = self.size
        while len(run):
            least = np.minimum.reduceat(pair << 32 | np.arange(len(pair)), starts_of(sizes))
            going = least < self.size << 32
            at = least & 0xFFFFFFFF
            if not going.all():
                stay = np.repeat(going, sizes)
                done.append(symbol[~stay])
                whose.append(run[~going])
                lengths.append(sizes[~going])
                at = (np.cumsum(stay) - 1)[at[going]]
                symbol, pair, run, sizes = symbol[stay], pair[stay], run[going], sizes[going]
            symbol[at] = pair[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol, pair, sizes = symbol[keep], pair[keep], sizes - 1
            at -= np.arange(len(at))
            first = starts_of(sizes)
            pair[at] = self.size
            for left in (at[at > first] - 1, at[at < first + sizes - 1]):
                pair[left] = self.rank(symbol[left], symbol[left + 1])
        order = np.argsort(np.concatenate(whose)) if whose else np.zeros(0, np.int64)
        lengths = np.concatenate(lengths).astype(np.int64) if lengths else np.zeros(0, np.int64)
        values = np.concatenate(done) if done else np.zeros(0, np.int64)
        return gather(values, starts_of(lengths)[order], lengths[order]), lengths[order]

    def joined(self, tokens: np.ndarray, sizes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Joins each part of left to the next one: a window around their border grows on each side until its
        outermost token is the one that stood there before."""
        border, before, after = starts_of(sizes)[left + 1], sizes[left], sizes[left + 1]
        i, j, open_ = np.ones_like(left), np.ones_like(left), np.arange(len(left))
        found, whose = [], []
        while len(open_):
            i[open_], j[open_] = np.minimum(i[open_], before[open_]), np.minimum(j[open_], after[open_])
            low, width = border[open_] - i[open_], i[open_] + j[open_]
            window = gather(tokens, low, width)
            widths = np.add.reduceat(self.length[window], starts_of(width))
            new, lengths = self.merged(gather(self.blob, self.start[window], self.length[window]), widths)
            ends = np.cumsum(lengths)
            steady_left = (i[open_] == before[open_]) | (new[ends - lengths] == tokens[low])
            steady_right = (j[open_] == after[open_]) | (new[ends - 1] == tokens[low + width - 1])
            ready = steady_left & steady_right
            found.append((gather(new, (ends - lengths)[ready], lengths[ready]), lengths[ready]))
            whose.append(open_[ready])
            i[open_[~steady_left]] *= 2
            j[open_[~steady_right]] *= 2
            open_ = open_[~ready]
            self.grown += len(open_)
        self.joins += len(left)
        lengths = np.concatenate([n for _, n in found])
        order = np.argsort(np.concatenate(whose))
        at = len(tokens) + starts_of(lengths)[order]
        # Three ranges for each part: what stays before a window, the window, what stays after it.
        begin, count = np.zeros((3, len(sizes)), np.int64), np.zeros((3, len(sizes)), np.int64)
        begin[0], count[0] = starts_of(sizes), sizes
        count[0, left] -= i
        begin[1, left], count[1, left] = at, lengths[order]
        begin[2, left], count[2, left] = border + j, after - j
        alone = np.ones(len(sizes), bool)
        alone[left + 1] = False
        begin, count = begin[:, alone], count[:, alone]
        return gather(np.concatenate([tokens, *(w for w, _ in found)]), begin.T.ravel(), count.T.ravel()), count.sum(axis=0)

    def reduce(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all pieces (none empty), and how many each has: leaves, then neighbours joined until each piece is one part."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        leaves = -(-sizes // LEAF_BYTES)
        parts = np.full(leaves.sum(), LEAF_BYTES, np.int64)
        parts[np.cumsum(leaves) - 1] = sizes - (leaves - 1) * LEAF_BYTES
        tokens, counts = self.merged(np.frombuffer(b"".join(pieces), np.uint8), parts)
        while (leaves > 1).any():
            place = np.arange(leaves.sum()) - np.repeat(starts_of(leaves), leaves)
            left = np.flatnonzero((place % 2 == 0) & (place + 1 < np.repeat(leaves, leaves)))
            tokens, counts = self.joined(tokens, counts, left)
            leaves = -(-leaves // 2)
        return tokens, counts


@dataclass(slots=True)
class Part:
    """A range of a text in pieces: those up to the first and from the last place where a piece starts whatever
    stands outside the range, and what lies between in strings that each start at such a place.  Without one: head alone."""

    head: list[str]
    body: list[str]
    tail: list[str] | None


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.tree = ranks, Tokens(ranks)
        self.pattern = regex.compile(pattern)
        space = regex.compile(r"\s")
        self.spaces = frozenset(c for c in map(chr, range(0x3100)) if space.match(c))
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.joins = 0

    def leaf(self, text: str) -> Part:
        """A space before a character that is no white space starts a piece, whatever stands before or after."""
        words = text.split(" ")
        starts = [k for k in range(1, len(words)) if words[k] and words[k][0] not in self.spaces]
        if not starts:
            return Part(self.pattern.findall(text), [], None)
        if len(starts) == len(words) - 1:
            body = [" " + w for w in words[1:-1]]
        else:
            body = [" " + " ".join(words[k:after]) for k, after in zip(starts, starts[1:], strict=False)]
        return Part(self.pattern.findall(" ".join(words[: starts[0]])), body, self.pattern.findall(" " + " ".join(words[starts[-1] :])))

    def join(self, left: list[str], right: list[str]) -> list[str]:
        """Pieces of two neighbours, by windows that grow as those of tokens do.  A match of the pattern looks at
        most LOOKAHEAD characters past its end; so many pieces of each side are to be found again."""
        if not left or not right:
            return left or right
        self.joins += 1
        i = j = LOOKAHEAD
        while True:
            a, b = left[-i:], right[:j]
            found = self.pattern.findall("".join(a + b))
            steady_left = i >= len(left) or found[0] == a[0]
            steady_right = j >= len(right) or found[-LOOKAHEAD:] == b[-LOOKAHEAD:]
            if steady_left and steady_right:
                return left[:-i] + found + right[j:]
            i, j = i * (1 if steady_left else 2), j * (1 if steady_right else 2)

    def part(self, text: str) -> Part:
        """Halves down to leaves, joined upwards."""
        if len(text) <= LEAF_CHARS:
            return self.leaf(text)
        half = cut(len(text))
        left, right = self.part(text[:half]), self.part(text[half:])
        if left.tail is None:
            return Part(self.join(left.head, right.head), right.body, right.tail)
        seam = self.join(left.tail, right.head)
        if right.tail is None:
            return Part(left.head, left.body, seam)
        left.body.append("".join(seam))
        left.body += right.body
        return Part(left.head, left.body, right.tail)

    def learn(self, strings: set[str]) -> dict[str, bytes]:
        """Ids (as int32 bytes) of strings that are new; frequent ones are kept, up to a bound."""
        fresh, found = [], {}
        for s in strings - self.recent.keys():
            if (ids := self.older.get(s)) is not None:
                self.recent[s] = ids
            else:
                fresh.append(s)
        split = [self.pattern.findall(s) for s in fresh]
        data = {p: p.encode() for pieces in split for p in pieces}
        ids = {p: _int32([self.ranks[d]]) for p, d in data.items() if d in self.ranks}
        rest = [p for p in data if p not in ids]
        if rest:
            tokens, counts = self.tree.reduce([data[p] for p in rest])
            flat, ends = _int32(tokens), np.cumsum(counts * 4).tolist()
            ids |= {p: flat[a:b] for p, a, b in zip(rest, [0, *ends], ends, strict=False)}
        for s, pieces in zip(fresh, split, strict=True):
            (self.recent if len(s) <= CACHED_CHARS else found)[s] = b"".join([ids[p] for p in pieces])
        return found

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of each text; all texts are reduced together."""
        parts = [self.part(t) if t else Part([], [], None) for t in texts]
        strings = [[*p.head, *p.body, *(p.tail or ())] for p in parts]
        long = self.learn(set(chain.from_iterable(strings)))
        get = self.recent.get if not long else lambda s: self.recent.get(s) or long[s]
        out = [np.frombuffer(b"".join(map(get, s)), np.int32) for s in strings]
        if len(self.recent) > CACHED:
            self.older, self.recent = self.recent, {}
        return out


def _int32(ids) -> bytes:
    return np.asarray(ids, np.int32).tobytes()


def concatenated(tokens: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of the ids: those of both halves, one after the other."""
    if len(ids) <= LEAF_TOKENS:
        return b"".join(tokens[ids])
    half = cut(len(ids))
    return concatenated(tokens, ids[:half]) + concatenated(tokens, ids[half:])


_ENCODERS: dict[tuple[int, str], Encoder] = {}


def _encoder(ranks, pattern: str) -> Encoder:
    """One for each worker, vocabulary and pattern; the cached words outlive a task."""
    key = (hash(ranks), pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(read_ranks(ranks), pattern)
    return _ENCODERS[key]


def _without(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in names))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of about CHARS_AT_ONCE bytes of text, at least one."""
    part = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)) // CHARS_AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            yield batch.slice(a, b - a)


def encode(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """Adds ids, the token ids of text.  ranks: a rank file's bytes (a vocabulary's size, whatever the corpus)."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    rows = _without(docs, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, pattern)
        for batch in batches:
            for part in slices(batch):
                found = encoder.encode(part.column("text").to_pylist())
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, "ids"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, ranks: bytes) -> DataFrame:
    """Adds decoded, the bytes that ids stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    rows = _without(encoded, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(shared.value)
        token = np.empty(max(ranks.values(), default=-1) + 1, object)
        for t, i in ranks.items():
            token[i] = t
        for batch in batches:
            ids = batch.column("ids")
            out = [concatenated(token, x.values.to_numpy()) if x.is_valid else None for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded", T.BinaryType())]))


def digests(encoded: DataFrame) -> DataFrame:
    """Adds n_tokens and ids_sha256, and decoded_sha256 for decoded, which goes."""
    return encoded.withColumns(
        {
            "n_tokens": F.size("ids").cast("long"),
            "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256),
            "decoded_sha256": F.sha2("decoded", 256),
        }
    ).drop("decoded")


def vocabulary(name: str = VOCABULARY) -> tuple[bytes, str]:
    """A public rank file's bytes and its pattern."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read(), public_tokenizers.PATTERN


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = vocabulary()
    encoded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern)
    return digests(decode(encoded.select("doc_id", "ids"), ranks)).drop("ids")
