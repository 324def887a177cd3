"""Operator 10, toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are a text's own words and the beginnings of longer ones (compounds share those), all of them,
whatever the labels say; only terms of a single example, which can't make anything similar, have no
postings.  A weight is (1 + log tf) * idf * (1 + evidence), where evidence is the likelihood ratio of a
term's toxic texts: about 0 for most terms, so their weights are the usual ones, while a word that goes
with the label isn't drowned by a long text's topic.  Vectors have length 1.

The index cuts the examples into small blocks, alike ones together: by the term that leads in common words, which tells
languages apart, then by the heaviest term.  Frequent terms keep their largest weight in each block, and a weight for each example.
A text's rare terms are scored at once; with the frequent terms' largest weights that bounds what an example of a block can
reach.  Blocks are scored in the order of their bounds, some at a time, until the next bound falls below the cosine of the last
neighbour asked for; the rest is never scored.  A block is scored for all of some texts that need it, as a product of matrices.
All examples as near as the last one count, so ties need no choice.  Votes are weighted by 1 / (1 - cosine + SOFTEN) ** SHARPNESS, with one vote of
the whole sample's share, and become probabilities by isotonic regression on votes that leave out each
example itself.  A text without any known term gets the sample's share of toxic texts.

Bounds: the labelled rows that it learns from are those of the least hash, at most MAX_EXAMPLES of
them and MAX_CHARS characters, so what is broadcast doesn't grow with the corpus.  Each text is scored
in one pass without a shuffle.

Defined results: null or empty text: the sample's share; texts are read whole; repeated or null
doc_ids: scored row by row (null: not held out); a document labelled twice: toxic if either says so;
equal texts: one example with as many votes; no labels: score 0; no rows: no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomweb.llm.shared import table, written

MAX_EXAMPLES, MAX_CHARS = 3_000, 64_000_000
PREFIXES = (5,)
NEIGHBOURS, SOFTEN, SHARPNESS = 100, 0.05, 8
BLOCK, FREQUENT, BLOCKS_AT_ONCE = 32, 300, 4
MOST_FREQUENT, TOGETHER = 1_024, 256  # terms with a weight for each example; texts that are scored together
THRESHOLD = 0.7
CACHED = 1 << 17
WORD = re.compile(r"[^\W_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def word_terms(word: str) -> list[str]:
    """The word, and its beginnings with a star."""
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k)]


def term_counts(text: str | None) -> Counter:
    counts: Counter = Counter()
    for word, n in Counter(WORD.findall((text or "").lower())).items():
        for term in word_terms(word):
            counts[term] += n
    return counts


@dataclass
class Examples:
    """Postings of distinct labelled texts: example and count of each term, by term; and the texts' votes."""

    terms: list[str]
    df: np.ndarray
    example: np.ndarray
    count: np.ndarray
    n: np.ndarray
    toxic: np.ndarray
    doc_id: np.ndarray

    def prior(self) -> float:
        return float(self.toxic.sum() / max(1, self.n.sum()))


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def evidence(toxic: np.ndarray, df: np.ndarray, share: float) -> np.ndarray:
    """The log-likelihood ratio of each term's toxic texts against the whole sample's share."""
    part = lambda seen, expected: seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12))
    return 2 * (part(toxic, df * share) + part(df - toxic, df * (1 - share)))


class Words(dict):
    """The row of each word met in terms, where ROW numbers of its known terms stand (-1: none); row 0 is that of all words without any."""

    ROW = 1 + len(PREFIXES)

    def __init__(self, number: dict[str, int]):
        self.number, self.terms = number.get, array("q", [-1] * self.ROW)

    def __missing__(self, word: str) -> int:
        found = [self.number(t, -1) for t in word_terms(word)]
        row = 0
        if max(found) >= 0:
            row = len(self.terms) // self.ROW
            self.terms.extend(found + [-1] * (self.ROW - len(found)))
        self[word] = row
        return row


class BlockMaxIndex:
    def __init__(self, examples: Examples, block: int = BLOCK, frequent: int = FREQUENT):
        e = self.examples = examples
        self.size, self.block = len(e.n), block
        self.blocks = max(1, -(-self.size // block))
        term, share = np.repeat(np.arange(len(e.terms)), e.df), e.toxic / np.maximum(e.n, 1)
        self.idf = np.log(1 + self.size / np.maximum(e.df, 1)) * (1 + evidence(np.bincount(term, share[e.example], len(e.terms)), e.df, share.mean() if self.size else 0.0))
        weight = (1 + np.log(e.count)) * self.idf[term]
        weight /= np.sqrt(np.maximum(np.bincount(e.example, weight**2, self.size), 1e-300))[e.example]
        # Alike examples go together: sorted by the term that weighs most by how many examples have it, then by the heaviest one.
        leads = []
        for key in (weight * e.df[term] / self.idf[term], weight):
            lead = np.zeros(self.size, np.int64)
            by = np.lexsort((-key, e.example))
            _, first = np.unique(e.example[by], return_index=True)
            lead[e.example[by][first]] = term[by][first] + 1
            leads.append(lead)
        self.order = np.lexsort(leads[::-1])
        place = np.empty(self.size, np.int64)
        place[self.order] = np.arange(self.size)
        entry = place[e.example]
        by = np.lexsort((entry, term))
        self.entry, self.weight = entry[by], weight[by]
        self.start = np.concatenate(([0], np.cumsum(e.df)))
        # Frequent terms: a row each of largest weights, and of all weights in each block.
        often = np.argsort(-e.df, kind="stable")[:MOST_FREQUENT]
        often = often[e.df[often] > frequent]
        self.row = np.full(len(e.terms), -1)
        self.row[often] = np.arange(len(often))
        at = gather(self.start[often], e.df[often])
        full = np.zeros((len(often), self.blocks * block))
        full[np.repeat(np.arange(len(often)), e.df[often]), self.entry[at]] = self.weight[at]
        full = full.reshape(len(often), self.blocks, block)
        self.most = full.max(axis=2)
        self.full = np.ascontiguousarray(full.transpose(1, 0, 2))
        self.number = {t: i for i, t in enumerate(e.terms)}
        self.n, self.toxic = e.n[self.order].astype(float), e.toxic[self.order].astype(float)
        self.scored = 0
        self.words = Words(self.number)

    def vectors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each text's terms begin (and the last ones end), numbers and weights of the known ones; words met before are kept, up to a bound."""
        if len(self.words) > CACHED:
            self.words = Words(self.number)
        rows = []
        for text in texts:
            words = WORD.findall((text or "").lower())
            rows.append(np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)))
        terms = max(1, len(self.idf))
        known = np.frombuffer(self.words.terms, np.int64).reshape(-1, Words.ROW)[np.concatenate(rows)]
        key = known + (np.repeat(np.arange(len(texts)), [len(r) for r in rows]) * terms)[:, None]
        key, counts = np.unique(key[known >= 0], return_counts=True)
        text, ids = np.divmod(key, terms)
        w = (1 + np.log(counts)) * self.idf[ids]
        w /= np.sqrt(np.maximum(np.bincount(text, w**2, len(texts)), 1e-300))[text]
        return np.searchsorted(text, np.arange(len(texts) + 1)), ids, w

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and weights of the known terms of a text."""
        return self.vectors([text])[1:]

    def nearest(self, ids: np.ndarray, q: np.ndarray, k: int = NEIGHBOURS, own: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines (descending), until they stand for k examples, with all as near as the last.

        own: a place that counts one example less (the one that asks).
        """
        return self.nearest_of_each(np.array([0, len(ids)]), ids, q, k, [own])[0]

    def nearest_of_each(self, starts: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int = NEIGHBOURS, own: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """nearest() of some texts at once: a block is scored for all that need it by a product of matrices."""
        texts = len(starts) - 1
        row, text = self.row[ids], np.repeat(np.arange(texts), np.diff(starts))
        score = np.empty((texts, self.blocks * self.block))
        for t in range(texts):
            some = slice(starts[t], starts[t + 1])
            rare = row[some] < 0
            i = ids[some][rare]
            sizes = self.examples.df[i]
            at = gather(self.start[i], sizes)
            score[t] = np.bincount(self.entry[at], np.repeat(q[some][rare], sizes) * self.weight[at], score.shape[1])
        common = np.zeros((texts, len(self.most)))
        common[text[row >= 0], row[row >= 0]] = q[row >= 0]
        by_block = score.reshape(texts, self.blocks, self.block)
        bound = by_block.max(axis=2) + common @ self.most
        order = np.argsort(-bound, axis=1, kind="stable")
        bound = np.where(bound > 0, bound, -1.0)
        seen, least = np.zeros((texts, self.blocks), bool), np.zeros(texts)
        done, some, enough = 0, BLOCKS_AT_ONCE, k + (own is not None)
        while done < self.blocks:
            need, now = np.zeros_like(seen), order[:, done : done + some]
            np.put_along_axis(need, now, np.take_along_axis(bound, now, 1) >= least[:, None] - 1e-9, 1)
            asking = np.flatnonzero(need.any(axis=1))
            if not len(asking):
                break
            for b in np.flatnonzero(need.any(axis=0)):
                t = np.flatnonzero(need[:, b])
                by_block[t, b] += common[t] @ self.full[b]
            seen |= need
            self.scored += int(need.sum())
            done, some = done + some, 2 * some
            # Each place stands for an example at least (but for the one that asks), so the cosine asked for is no less than this.
            if enough <= done * self.block and done < self.blocks:
                at = asking[:, None], order[asking, :done]
                kept = np.where(seen[at][:, :, None], by_block[at], 0.0).reshape(len(asking), -1)
                least[asking] = np.partition(kept, -enough, axis=1)[:, -enough]
        by_block[~seen] = 0.0
        return [self.best(score[t], float(least[t]), k, own[t] if own else -1) for t in range(texts)]

    def best(self, score: np.ndarray, least: float, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples, and all as near as the last; none of them is below least."""
        places = np.flatnonzero((score > 0) & (score >= least - 1e-9))
        places = places[np.argsort(-score[places], kind="stable")]
        enough = np.flatnonzero(np.cumsum(self.n[places] - (places == own)) >= k)
        if len(enough):
            places = places[score[places] >= score[places[enough[0]]] - 1e-9]
        return places, np.minimum(score[places], 1.0)

    def share(self, places: np.ndarray, cosines: np.ndarray, own: int = -1, own_toxic: int = 0) -> float:
        """The share of toxic votes, weighted by distance."""
        n, toxic = self.n[places], self.toxic[places]
        if own >= 0:
            n, toxic = n - (places == own), toxic - (places == own) * own_toxic
        w = (1 - cosines + SOFTEN) ** -SHARPNESS
        return float((w @ toxic + self.examples.prior()) / (w @ n + 1))

    def vote(self, ids: np.ndarray, q: np.ndarray, own: int = -1, own_toxic: int = 0) -> tuple[float, np.ndarray, np.ndarray]:
        """The share of toxic votes, and the neighbours that gave them."""
        places, cosines = self.nearest(ids, q, own=own)
        return self.share(places, cosines, own, own_toxic), places, cosines


def isotonic(votes: np.ndarray, share: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a non-decreasing function; each pool gets half a vote of either label."""
    pools: list[list[float]] = []
    for v, s, w in sorted(zip(votes, share, weight, strict=True)):
        pools.append([v * w, s * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top, strict=True)]
    x = np.array([v / w for v, _, w in pools])
    y = np.maximum.accumulate([(s + 0.5) / (w + 1) for _, s, w in pools]) if pools else np.zeros(0)
    return x, y


@dataclass
class Model:
    examples: Examples
    knots: tuple[np.ndarray, np.ndarray]


class Scorer:
    def __init__(self, model: Model):
        self.index, self.knots = BlockMaxIndex(model.examples), model.knots

    def score(self, texts: list[str | None]) -> list[tuple[float, str]]:
        """Scores, and evidence: the three nearest examples as doc_id:cosine:share of toxic ones."""
        starts, ids, q = self.index.vectors(texts)
        e, near = self.index.examples, self.index.nearest_of_each(starts, ids, q)
        known = np.diff(starts) > 0
        votes = np.interp([self.index.share(*x) if k else 0.0 for x, k in zip(near, known, strict=True)], *self.knots)
        out = []
        for vote, k, (places, cosines) in zip(votes.tolist(), known, near, strict=True):
            at = self.index.order[places[:3]]
            evidence = ",".join(f"{d}:{c:.4f}:{t / n:.2f}" for d, c, t, n in zip(e.doc_id[at].tolist(), cosines.tolist(), e.toxic[at].tolist(), e.n[at].tolist(), strict=False))
            out.append((vote, evidence) if k else (e.prior(), ""))
        return out


def sampled(docs: DataFrame, labels: DataFrame, most: int = MAX_EXAMPLES, most_chars: int = MAX_CHARS) -> DataFrame:
    """text, n, toxic and doc_id of the distinct texts of the sampled labelled rows that aren't held out."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]), "toxicity-sample")
    so_far = F.sum(F.coalesce(F.char_length("text"), F.lit(0))).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # at most MAX_EXAMPLES rows
    kept = rows.select("doc_id", so_far.alias("chars")).filter(F.col("chars") <= most_chars).select("doc_id")
    return rows.join(F.broadcast(kept), "doc_id", "left_semi").groupBy("text").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if counts := term_counts(text):
                yield pa.RecordBatch.from_pydict({"term": pa.array(counts), "doc_id": pa.array([doc_id] * len(counts), pa.int64()), "n": pa.array(counts.values(), pa.int32())})


def gathered(sample: DataFrame) -> Examples:
    """The sample's postings; terms of one example go before they reach the driver."""
    heads = sample.select("doc_id", "n", "toxic").orderBy("doc_id").toArrow()
    doc_id = heads["doc_id"].to_numpy()
    rows = sample.select("doc_id", "text").mapInArrow(_counted, "term string, doc_id long, n int")
    by_term = rows.groupBy("term").agg(F.collect_list(F.struct("doc_id", "n")).alias("in")).filter(F.size("in") > 1)  # a list has at most MAX_EXAMPLES rows
    found = by_term.select("term", "in.doc_id", "in.n").orderBy("term").toArrow().combine_chunks()
    ids, counts = (found[c].combine_chunks() for c in ("doc_id", "n"))
    df = np.diff(ids.offsets.to_numpy()).astype(np.int64)
    return Examples(found["term"].to_pylist(), df, np.searchsorted(doc_id, ids.flatten().to_numpy()), counts.flatten().to_numpy(), heads["n"].to_numpy(), heads["toxic"].to_numpy(), doc_id)


def learn(docs: DataFrame, labels: DataFrame, most: int = MAX_EXAMPLES) -> Model:
    examples = gathered(written(sampled(docs, labels, most), "toxicity-examples"))
    return Model(examples, calibrated(docs.sparkSession, examples))


def own_votes(index: BlockMaxIndex, places: list[int]) -> list[tuple[float, int, int]]:
    """(vote, label, how many) on each example by the others; examples without a shared term are left to the prior."""
    e, out = index.examples, []
    by = np.argsort(index.entry, kind="stable")
    term = np.repeat(np.arange(len(e.terms)), e.df)
    cuts = np.searchsorted(index.entry[by], np.arange(index.size + 1))
    for i in range(0, len(places), TOGETHER):
        some = np.array(places[i : i + TOGETHER])
        sizes = cuts[some + 1] - cuts[some]
        at = by[gather(cuts[some], sizes)]  # weights of examples are of length 1 already
        near = index.nearest_of_each(np.concatenate(([0], np.cumsum(sizes))), term[at], index.weight[at], own=some.tolist())
        for p, known, found in zip(some.tolist(), sizes, near, strict=True):
            toxic, n = int(index.toxic[p]), int(index.n[p])
            out += [(index.share(*found, p, label), label, c) for label, c in ((1, toxic), (0, n - toxic)) if c and known]
    return out


def calibrated(spark: SparkSession, examples: Examples) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic knots from the votes on each example by the others."""
    if not len(examples.terms):
        return np.zeros(1), np.full(1, examples.prior())
    shared = spark.sparkContext.broadcast(examples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            index = index or BlockMaxIndex(shared.value)
            if out := own_votes(index, batch.column("id").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["vote", "label", "n"])

    votes = spark.range(len(examples.n)).mapInArrow(run, "vote double, label long, n long")
    rows = votes.groupBy("vote").agg(F.sum(F.col("label") * F.col("n")).alias("toxic"), F.sum("n").alias("n")).toArrow()
    vote, toxic, n = (rows[c].to_numpy().astype(float) for c in ("vote", "toxic", "n"))
    return isotonic(vote, toxic / n, n)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and evidence of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            cuts = range(0, batch.num_rows, TOGETHER)
            found = [x for i in cuts for x in scorer.score(batch.column("text").slice(i, TOGETHER).to_pylist())]
            arrays = [batch.column("doc_id"), pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "score", "evidence"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, evidence string")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    scored = score_toxicity(docs, learn(docs, labels))
    predicted = (F.col("score") >= THRESHOLD).cast("int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"), "evidence")
