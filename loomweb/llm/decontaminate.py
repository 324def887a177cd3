"""Operator 3, benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

All runs of 3 to 8 words of the test items are counted over all documents.  A seed is, at each place of
an item, the shortest run that occurs no more than FEW times, or hardly more often than the item's
rarest run (which is always a seed): so a boilerplate phrase is no seed of an item that has anything
rarer, and of a passage that leaked many times all places still are.  Seeds join the documents' word
runs to the items.  The runs of SHORTEST words that are too frequent for a seed are looked up as well; where
one occurs, the item is a candidate if the words around it, counted, can reach the similarity asked for (see
Frequent; this drops no passage that an alignment would take).  Each place gives a diagonal; diagonals of a document and an item that lie
near each other are aligned together, word by word, within a band around them; the similarity is the
share of the item's words that the best local alignment matches.

So a copy is missed only if it keeps no SHORTEST words of the item in a row, however frequent they are.  With a fifth of the
words changed or left out some always stay so, but for items of five words whose middle one is changed; many words put in
between others can break all.  An item of fewer than SHORTEST words can't be told from chance inside other text: only a document that
consists of just these words is its copy.

Bounds: items are taken in blocks of about BLOCK_WORDS words.  What is broadcast and passes the driver
are the distinct words of one block's items, 8-byte digests of its runs and the reach of its seeds, and, as numbers, the words of
items with frequent runs; places and counts stay in tables.  All documents are read twice for each block.  An alignment keeps two rows of its band.

Defined results: null or empty texts (of either table): no match; texts are read whole; repeated
items: one match each; rows that share a doc_id (or have none): one match for an item and the id;
ties: the passage that starts first; no rows: no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomweb.llm.shared import table, written

SHORTEST, LONGEST = 3, 8
FEW, TIMES_RAREST = 20, 4
SIMILARITY = 0.8
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_WORDS = 1_000_000
CACHED, TEXTS_AT_ONCE = 1 << 17, 256
FACTOR = np.uint64(0x9E3779B97F4A7C15)
WORD = re.compile(r"\w+")
HITS = pa.list_(pa.struct([("place", pa.int32()), ("run", pa.int64()), ("item", pa.int64()), ("diagonal", pa.int32())]))


def words_of(text: str | None) -> list[str]:
    """Lower-cased one by one, so that they stay aligned with the text's own words."""
    if text and "Σ" not in text and "İ" not in text:  # all other characters keep their length and kind, whatever is next to them
        return WORD.findall(text.lower())
    found = WORD.findall(text or "")
    return "\n".join(found).lower().split("\n") if found else []


class Digests(dict):
    """64-bit digests of words; words met before are kept, up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def runs_of(digests: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """Digests of the runs of n words at some places (all where at is not given), as signed numbers."""
    at = np.arange(len(digests) - n + 1) if at is None else at
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = (out ^ digests[at + k]) * FACTOR
        out ^= out >> np.uint64(29)
    return (out * FACTOR ^ np.uint64(n)).view(np.int64)


def within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the known ones (sorted)."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def smith_waterman(a: list, b: list, low: int | None = None, high: int | None = None) -> tuple[int, int, int]:
    """The best local alignment of a to b whose diagonals (place in b less place in a) lie within low and high:
    matched words, and its place in b (end exclusive).  Of equal scores the one with most matches, then the first start.

    A cell is one number: score, matches and start, the score in the highest bits, so that rows need no way back.
    """
    low, high = (-len(a) if low is None else low), (len(b) if high is None else high)
    if not a or not b or high < low:
        return 0, 0, 0
    number = {w: i for i, w in enumerate(dict.fromkeys(a))}
    x, y = np.array([number[w] for w in a]), np.array([number.get(w, -1) for w in b])
    width = high - low + 1
    start_bits, match_bits = len(b).bit_length(), len(a).bit_length()
    one, unit = 1 << start_bits, 1 << (start_bits + match_bits)
    latest = one - 1
    steps = np.arange(width, dtype=np.int64) * (-GAP * unit)
    column = np.arange(width) + low
    nothing = -(1 << 62)
    before = np.full(width + 1, nothing, np.int64)
    best, end = nothing, 0
    for i, word in enumerate(x):
        j = column + i
        inside = (j >= 0) & (j < len(b))
        fresh = np.where(inside, latest - j, nothing)
        same = y[np.clip(j, 0, len(b) - 1)] == word
        now = np.maximum(before[:-1], fresh) + np.where(same, MATCH * unit + one, MISMATCH * unit)
        now = np.maximum(now, before[1:] + GAP * unit)  # a word of a that b lacks
        now[~inside] = nothing
        now = np.maximum.accumulate(now + steps) - steps  # words of b that a lacks
        before[:-1] = np.where(inside & (now > nothing // 2), now, nothing)
        top = int(before.argmax())
        if before[top] > best:
            best, end = int(before[top]), int(j[top]) + 1 if top < width else 0
    if best < unit:
        return 0, 0, 0
    return (best >> start_bits) & ((1 << match_bits) - 1), latest - (best & latest), end


def clusters(diagonals: list[int], slack: int) -> list[tuple[int, int]]:
    """Bands (low, high) around diagonals, apart by more than twice the slack."""
    found: list[list[int]] = []
    for d in sorted(diagonals):
        if found and d - found[-1][1] <= 2 * slack:
            found[-1][1] = d
        else:
            found.append([d, d])
    return [(low - slack, high + slack) for low, high in found]


def slack_of(n: int) -> int:
    """How far an alignment may leave its seeds' diagonal."""
    return n // 4 + 2


def align(item: list[str], passage: list[str], diagonals: list[int]) -> list[tuple[float, int, int]]:
    """(similarity, start, end) in words for each cluster of diagonals."""
    out = []
    for low, high in clusters(diagonals, slack_of(len(item))):
        first, last = max(0, low), min(len(passage), len(item) + high)
        matched, start, end = smith_waterman(item, passage[first:last], low - first, high - first)
        out.append((matched / len(item), first + start, first + end))
    return out


def item_runs(items: DataFrame) -> DataFrame:
    """items: item, text.  item, size (in words), at, n, run and head (the run's first SHORTEST words), for all runs of SHORTEST
    to LONGEST words; an item that is shorter: the whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = Digests()
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                d = digests.of(words_of(text))
                for n in range(min(SHORTEST, max(1, len(d))), min(LONGEST, len(d)) + 1):
                    found = runs_of(d, n)
                    head = runs_of(d, min(SHORTEST, len(d)))[: len(found)]
                    same = lambda v, kind, k=len(found): pa.array(np.full(k, v), kind)
                    arrays = [same(item, pa.int64()), same(len(d), pa.int32()), pa.array(np.arange(len(found), dtype=np.int32)), same(n, pa.int32()), pa.array(found), pa.array(head)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["item", "size", "at", "n", "run", "head"])

    return items.select("item", "text").mapInArrow(run, "item long, size int, at int, n int, run long, head long")


def known_runs(runs: DataFrame) -> list[np.ndarray]:
    """For each number of words the sorted digests of runs (one block's)."""
    rows = runs.select("n", "run").distinct().toArrow()
    n, run = rows["n"].to_numpy(), rows["run"].to_numpy()
    return [np.sort(run[n == k]) for k in range(LONGEST + 1)]


class Places:
    """Finds one block's runs in texts.  Words that no item has are told apart first, which leaves little to digest."""

    def __init__(self, vocabulary: list[str], known: list[np.ndarray], heads: np.ndarray):
        """known: for each number of words the runs' sorted digests; heads: those of the runs' first SHORTEST words."""
        self.number = {w: i for i, w in enumerate(vocabulary, 1)}
        self.digests = np.concatenate((np.zeros(1, np.uint64), Digests().of(vocabulary)))
        self.known, self.heads = known, heads

    def __call__(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text's number, place, run) of all known runs in some texts' words, which are looked through together."""
        sizes = np.array([len(words) + 1 for words in texts], np.int64)  # an unknown word after each text keeps runs within it
        words = chain.from_iterable(chain.from_iterable((ws, ("",)) for ws in texts))
        ids = np.fromiter(map(self.number.get, words, repeat(0)), np.int32, sizes.sum())
        firsts, found = np.cumsum(sizes) - sizes, []
        for k in np.flatnonzero(sizes <= SHORTEST):
            own = ids[firsts[k] : firsts[k] + sizes[k] - 1]
            if len(own) and own.all():
                whole = runs_of(self.digests[own], len(own))
                if within(whole, self.known[len(own)])[0]:
                    found.append((np.array([firsts[k]]), whole))
        at = np.flatnonzero((ids[:-2] > 0) & (ids[1:-1] > 0) & (ids[2:] > 0))
        digests = self.digests[ids]
        at = at[within(runs_of(digests, SHORTEST, at), self.heads)]
        for n in range(SHORTEST, LONGEST + 1):
            at = at[at + n <= len(ids)]
            run = runs_of(digests, n, at)
            hit = within(run, self.known[n])
            found.append((at[hit], run[hit]))
        place, run = (np.concatenate(x) for x in zip(*found, strict=True))
        text = np.searchsorted(firsts, place, "right") - 1
        return text, place - firsts[text], run


def vocabulary_of(items: DataFrame) -> list[str]:
    """The distinct words of one block's items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"word": pa.array(sorted({w for t in batch.column("text").to_pylist() for w in words_of(t)}), pa.string())})

    return items.select("text").mapInArrow(run, "word string").distinct().orderBy("word").toArrow()["word"].to_pylist()


def in_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (batch.slice(k, TEXTS_AT_ONCE) for k in range(0, len(batch), TEXTS_AT_ONCE))


def counted(docs: DataFrame, runs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """run and n_seen: how often each of one block's runs occurs in all documents; added up in each task before the shuffle."""
    known = known_runs(runs)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, known, known[SHORTEST]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(*shared.value)
        for batch in batches:
            runs = [places([words_of(t) for t in part.column(0).to_pylist()])[2] for part in in_slices(batch)]
            if runs:
                value, n = np.unique(np.concatenate(runs), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n)], names=["run", "n_seen"])

    return docs.select("text").mapInArrow(run, "run long, n_seen long").groupBy("run").agg(F.sum("n_seen").alias("n_seen"))


def seeds_of(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """item, size, at, n, run, head and rare: the seeds, and the shortest runs that are too frequent for one (not rare)."""
    seen = runs.join(counts, "run", "left").fillna(0, ["n_seen"])
    rarest = seen.groupBy("item").agg(F.min("n_seen").alias("rarest"))
    few = F.greatest(F.lit(FEW), F.col("rarest") * TIMES_RAREST)
    seen = seen.join(rarest, "item").withColumn("rare", F.col("n_seen") <= few)
    rare = seen.filter("rare").groupBy("item", "size", "at").agg(F.min(F.struct("n", "run", "head", "rare")).alias("seed")).select("item", "size", "at", "seed.*")
    frequent = seen.filter(~F.col("rare") & (F.col("n") <= SHORTEST))
    return rare.unionByName(frequent.select(*rare.columns))


class Frequent:
    """Which items can reach a similarity where one of their frequent runs occurs.

    An alignment matches no more of an item's words than the stretch has, counted word by word.  If it matches
    `need` of them, at most size - need are unmatched, so the stretch has one of any size - need + 1 of them: those that
    fewest items have are indexed, and only items found by these are counted.
    """

    def __init__(self, run: np.ndarray, item: np.ndarray, at: np.ndarray, words: dict[int, np.ndarray], least: float):
        """run, item, at: the places of frequent runs; words: each item's words as numbers."""
        order = np.lexsort((item, run))
        self.run, self.item, self.at = run[order], item[order], at[order]
        self.runs = np.unique(run)
        size = {i: len(w) for i, w in words.items()}
        self.need = {i: max(1, next(m for m in range(n + 1) if m >= n or m / n >= least)) for i, n in size.items()}
        self.words = {i: np.unique(w, return_counts=True) for i, w in words.items()}
        held, n_held = np.unique(np.concatenate([np.zeros(0, np.int64), *(w for w, _ in self.words.values())]), return_counts=True)
        found = [(w[np.lexsort((w, n_held[np.searchsorted(held, w)]))[: size[i] - self.need[i] + 1]], i) for i, w in words.items()]
        word = np.concatenate([np.zeros(0, np.int64), *(w for w, _ in found)])
        order = np.argsort(word, kind="stable")
        self.word, self.owner = word[order], np.repeat(np.array([i for _, i in found], np.int64), [len(w) for w, _ in found])[order]

    def items_in(self, stretch: list[int]) -> set[int]:
        """The items that a stretch (its words as numbers) can hold."""
        counts = Counter(stretch)
        words = np.array(list(counts), np.int64)
        low, high = np.searchsorted(self.word, words), np.searchsorted(self.word, words, "right")
        items = {i for a, b in zip(low.tolist(), high.tolist(), strict=True) if a < b for i in self.owner[a:b].tolist()}
        return {i for i in items if sum(min(n, counts[w]) for w, n in zip(*(x.tolist() for x in self.words[i]), strict=True)) >= self.need[i]}

    def places_of(self, run: int, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the items (sorted) that have the run, and where."""
        low, high = np.searchsorted(self.run, run), np.searchsorted(self.run, run, "right")
        has = within(self.item[low:high], items)
        return self.item[low:high][has], self.at[low:high][has]


def frequent_of(seeds: DataFrame, items: DataFrame, vocabulary: list[str], least: float) -> Frequent:
    rows = seeds.filter(~F.col("rare")).select("run", "item", "at").toArrow()
    texts = items.join(seeds.filter(~F.col("rare")).select("item").distinct(), "item", "left_semi").select("item", "text").toArrow()
    number = {w: i for i, w in enumerate(vocabulary, 1)}
    words = {i: np.array([number[w] for w in words_of(t)], np.int64) for i, t in zip(texts["item"].to_pylist(), texts["text"].to_pylist(), strict=True)}
    return Frequent(rows["run"].to_numpy(), rows["item"].to_numpy(), rows["at"].to_numpy(), words, least)


def windows(docs: DataFrame, seeds: DataFrame, items: DataFrame, vocabulary: list[str], least: float) -> DataFrame:
    """docs: id, text.  id, start (code points), passage and hits (place in the passage's words and run of each seed; of frequent runs
    the item and the diagonal as well): the stretches that items with a hit there may cover, overlapping ones as one."""
    slack = F.floor(F.col("size") / 4).cast("int") + 2
    reach = seeds.groupBy("n", "run").agg(F.max(F.col("at") + slack).alias("left"), F.max(F.col("size") - F.col("at") + slack).alias("right"), F.max("rare").alias("rare")).orderBy("run").toArrow()
    n, run, left, right, rare = (reach[c].to_numpy() for c in ("n", "run", "left", "right", "rare"))
    heads = np.sort(seeds.select("head").distinct().toArrow()["head"].to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast(((vocabulary, [run[n == k] for k in range(LONGEST + 1)], heads), Reach(run, left, right), run[rare], frequent_of(seeds, items, vocabulary, least)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, reach, seeds, frequent = shared.value
        places = Places(*finder)
        for batch in batches:
            for part in in_slices(batch):
                texts, rows = part.column("text").to_pylist(), []
                words = [words_of(t) for t in texts]
                which, at, runs = places(words)
                order = np.argsort(which, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(which[order])) + 1) if len(order) else ():
                    k = int(which[own[0]])
                    is_seed = within(runs[own], seeds)
                    hits = [(p, r, None, None) for p, r in zip(at[own][is_seed].tolist(), runs[own][is_seed].tolist(), strict=True)]
                    hits += _frequent_hits(words[k], at[own], runs[own], reach, frequent, places.number)
                    if hits:
                        rows += [(k, *w) for w in _stretches(texts[k], len(words[k]), hits, reach)]
                if rows:
                    k, start, passage, hits = zip(*rows, strict=True)
                    arrays = [part.column("id").take(pa.array(k)), pa.array(start, pa.int32()), pa.array(passage, pa.string()), pa.array(hits, HITS)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["id", "start", "passage", "hits"])

    hit = T.StructType().add("place", "integer").add("run", "long").add("item", "long").add("diagonal", "integer")
    columns = T.StructType().add("start", "integer").add("passage", "string").add("hits", T.ArrayType(hit))
    return docs.select("id", "text").mapInArrow(find, T.StructType([docs.schema["id"], *columns.fields]))


class Reach(NamedTuple):
    """How many words before and after a run its items may cover; runs sorted."""

    run: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def stretches(self, at: np.ndarray, runs: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """First word, end and hits of the stretches that hits in a text of that size reach, overlapping ones as one."""
        which = np.searchsorted(self.run, runs)
        low, high = np.maximum(at - self.left[which], 0), np.minimum(at + self.right[which], size)
        first = np.argsort(low, kind="stable")
        reach = np.maximum.accumulate(high[first])
        cuts = [0, *(np.flatnonzero(low[first][1:] >= reach[:-1]) + 1).tolist(), len(at)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield int(low[first[a]]), int(reach[b - 1]), first[a:b]


def _frequent_hits(words: list[str], at: np.ndarray, runs: np.ndarray, reach: Reach, frequent: Frequent, number: dict[str, int]) -> Iterator[tuple[int, int, int, int]]:
    """Place, run, item and the run's place in it, for the items that the words around their frequent runs allow."""
    known = within(runs, frequent.runs)
    if not known.any():
        return
    for begin, end, inside in reach.stretches(at, runs, len(words)):  # seeds too, for their diagonals widen an alignment
        mine = inside[known[inside]]
        if len(mine):
            items = np.array(sorted(frequent.items_in([number.get(w, 0) for w in words[begin:end]])), np.int64)
            for i in mine.tolist() if len(items) else ():
                for item, place in zip(*(x.tolist() for x in frequent.places_of(runs[i], items)), strict=True):
                    yield int(at[i]), int(runs[i]), item, place


def _stretches(text: str, size: int, hits: list[tuple], reach: Reach) -> Iterator[tuple[int, str, list[dict]]]:
    hits = sorted(hits, key=lambda hit: hit[0])
    at, runs = np.array([hit[0] for hit in hits], np.int64), np.array([hit[1] for hit in hits], np.int64)
    spans = [m.span() for m in WORD.finditer(text)]
    for begin, end, inside in reach.stretches(at, runs, size):
        found = ((hits[i][0] - begin, *hits[i][1:]) for i in inside.tolist())
        yield spans[begin][0], text[spans[begin][0] : spans[end - 1][1]], [{"place": p, "run": r, "item": i, "diagonal": None if i is None else p - a} for p, r, i, a in found]


def candidates(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """found: window, hits.  window, item and diagonals: seeds by an equality join on the runs, frequent runs as they were found."""
    hits = found.select("window", F.explode("hits").alias("hit")).select("window", "hit.*")
    joined = hits.filter("item IS NULL").select("window", "place", "run").join(seeds.filter("rare").select("run", "item", "at"), "run")
    both = joined.select("window", "item", (F.col("place") - F.col("at")).alias("diagonal")).unionByName(hits.filter("item IS NOT NULL").select("window", "item", "diagonal"))
    return both.groupBy("window", "item").agg(F.collect_set("diagonal").alias("diagonals"))


def aligned(pairs: DataFrame) -> DataFrame:
    """pairs: id, start, passage, item_id, text (the item's) and diagonals, dealt out evenly.  id, item_id, similarity, start and end
    (code points of the document) of each alignment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, list] = {}  # of equal passages, up to a bound
        for batch in batches:
            out, rows = [], zip(*(batch.column(c).to_pylist() for c in ("start", "passage", "text", "diagonals")), strict=True)
            for k, (start, passage, item, diagonals) in enumerate(rows):
                key = passage, item, tuple(sorted(diagonals))
                if key not in seen:
                    if len(seen) >= 1 << 12:
                        seen.clear()
                    spans = [m.span() for m in WORD.finditer(passage)]
                    best = align(words_of(item), words_of(passage), diagonals)
                    seen[key] = [(s, spans[a][0], spans[b - 1][1]) for s, a, b in best if s]
                out += [(k, s, start + a, start + b) for s, a, b in seen[key]]
            if out:
                k, similarity, start, end = zip(*out, strict=True)
                arrays = [batch.column("id").take(pa.array(k)), batch.column("item_id").take(pa.array(k)), pa.array(similarity), pa.array(start, pa.int64()), pa.array(end, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "item_id", "similarity", "start", "end"])

    columns = T.StructType().add("similarity", "double").add("start", "long").add("end", "long")
    return pairs.mapInArrow(run, T.StructType([pairs.schema["id"], pairs.schema["item_id"], *columns.fields]))


def alignments(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS, least: float = SIMILARITY) -> DataFrame | None:
    """docs: id, text.  id, item_id, similarity, start and end of aligned places, all of at least that similarity among them; None
    without items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL AND item_id IS NOT NULL")
    items = written(items.withColumn("item", F.monotonically_increasing_id()), "benchmark-items")
    runs = written(item_runs(items), "benchmark-runs")
    words = runs.select("item", "size").distinct().agg(F.sum("size")).first()[0]
    if not words:
        return None
    blocks, parts = -(-words // block_words), []
    for k in range(blocks):
        own = runs.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k) if blocks > 1 else runs
        vocabulary = vocabulary_of(items.join(own.select("item").distinct(), "item", "left_semi"))
        seeds = written(seeds_of(own, written(counted(docs, own, vocabulary), "benchmark-counts")), "benchmark-seeds")
        found = written(windows(docs, seeds, items, vocabulary, least).withColumn("window", F.monotonically_increasing_id()), "benchmark-windows")
        pairs = candidates(found, seeds).join(items, "item").join(found.drop("hits"), "window")
        dealt = pairs.select("id", "start", "passage", "item_id", "text", "diagonals", "window", "item").repartition(F.col("window"), F.col("item"))
        parts.append(aligned(dealt.drop("window", "item")))
    return reduce(DataFrame.unionByName, parts)


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, the best similarity and its place, and the number of leaked passages."""
    found = alignments(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), benchmark, block_words, least)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, similarity double, start long, end long, n_passages long")
    best = F.max(F.struct("similarity", (-F.col("start")).alias("minus"), "end")).alias("best")
    found = found.filter(F.col("similarity") >= least).groupBy(F.col("id").alias("doc_id"), "item_id").agg(best, F.count("*").alias("n_passages"))
    return found.select("doc_id", "item_id", "best.similarity", (-F.col("best.minus")).alias("start"), "best.end", "n_passages")


def drop_leaked(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs without a leaked passage, with the same columns; rows of equal texts share their fate."""
    digest = F.md5(F.col("text").cast("binary"))
    found = alignments(docs.select(digest.alias("id"), "text"), benchmark, block_words, least)
    if found is None:
        return docs
    leaked = written(found.filter(F.col("similarity") >= least).select(F.col("id").alias("leaked_id")).distinct(), "benchmark-leaked")
    return docs.join(leaked, digest == F.col("leaked_id"), "left_anti")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
