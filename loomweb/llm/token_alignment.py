"""Operator 12, alignment of two tokenizers' tokens over the same bytes.

A text (with a space before it) is encoded by tokenizer A, a byte-level BPE, and by tokenizer B, a BPE over pieces
with byte fallback.  B's tokens are the intervals of a static index, their starts and their ends, each sorted.  For
each A token two bisections stab that index: the first B token that ends after its start and the last one
that starts before its end; those between overlap it, and each such pair of occurrences is a link.  A gap between
two B tokens that no A token spans is the border of a group.

Neither tokenizer looks across a space or a line end that stands between two visible characters: A's pattern starts
a piece there, and no piece of B has either after another character (segmentable() checks that).  Texts are cut
there into segments, and each distinct segment is encoded and aligned once for many texts; a bounded number of them is kept.

One pass encodes, and stores each text's distinct pairs of linked ids and how often each occurs.  Their
corpus-wide counts are summed up from there, in the tasks first, and a last pass adds them up for each text.  Pairs of more
than one in HOT_LINKS of all links, which are fewer than HOT_LINKS whatever the corpus, are broadcast as arrays; the other
pairs of a text, none of which is hot, join their counts.  A B id's highest count is broadcast, a row for each id.

Defined results: null and empty texts, and texts that either tokenizer does not give back as they are: no tokens, all
counts 0 and no groups; repeated rows and ids: each row counts and has a result; texts are read whole; no rows: no rows;
extra columns are ignored by the query and kept by align(), except for the names that it adds.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomweb.llm.bpe import gather, slices, starts_of
from loomweb.llm.shared import new_folder, table

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Segments kept by a task, and the longest that is kept.
CACHED, CACHED_CHARS = 1 << 17, 48
#: Characters of distinct segments that are encoded as one string.
JOINED_CHARS = 20_000
HOT_LINKS = 1 << 19
ROWS_AT_ONCE = 1000
#: A pair of ids as one number: A's id times this plus B's.
WIDTH = 1 << 20


def byte_of_letter() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte: visible bytes as themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class TokenizerA:
    def __init__(self, data: str):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_str(data)
        self.inner.encode_special_tokens = True
        letters = byte_of_letter()
        special = {t.content for t in self.inner.get_added_tokens_decoder().values()}
        vocabulary = self.inner.get_vocab(with_added_tokens=True)
        self.bytes: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = token.encode() if token in special else bytes(letters[c] for c in token)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Tokens of texts, as they are."""
        return [e.ids for e in self.inner.encode_batch_fast(texts, add_special_tokens=False)]


class TokenizerB:
    def __init__(self, data: bytes):
        import sentencepiece

        self.inner = sentencepiece.SentencePieceProcessor(model_proto=data)
        ids = range(self.inner.get_piece_size())
        self.bytes = [bytes([int(self.inner.id_to_piece(i)[1:-1], 16)]) if self.inner.is_byte(i) else self.inner.id_to_piece(i).replace("▁", " ").encode() for i in ids]

    def segmentable(self) -> bool:
        """Whether no piece has a space after another character, or a line end beside another."""
        return not any(b" " in token.lstrip(b" ") or (b"\n" in token and len(token) > 1) for token in self.bytes)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Tokens of texts; the tokenizer adds a space itself, which is the text's own, or a token of its own before a line end."""
        found = self.inner.encode([t[1:] if t[:1] == " " else t for t in texts], num_threads=1)
        return [x if t[:1] == " " else x[1:] for x, t in zip(found, texts, strict=True)]


def is_visible(c: str) -> bool:
    return c > " " and c.isprintable()


def segments(text: str) -> list[str]:
    """text, which starts with a space, cut before each single space or line end between two visible characters."""
    marked = text.replace("\n", " \n")  # a segment's own first character is the one after the space, if that is a line end
    words = marked.split(" ")
    if text.replace("\n", "").isprintable() and all(words[1:]) and "\n" not in words:
        return [w if w[0] == "\n" else " " + w for w in words[1:]]
    found, start = [], 0
    for k in range(2, len(text) - 1):
        if text[k] in " \n" and is_visible(text[k - 1]) and is_visible(text[k + 1]):
            found.append(text[start:k])
            start = k
    return [*found, text[start:]]


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each A token the first and the last B token that it overlaps, and for each B token whether a group ends
    with it.  a, b: the tokens' sizes in bytes; both cover the same bytes."""
    a_ends, b_ends = np.cumsum(a), np.cumsum(b)
    first = np.searchsorted(b_ends, a_ends - a, "right")
    last = np.searchsorted(b_ends - b, a_ends, "left") - 1
    change = np.bincount(first, minlength=len(b) + 1) - np.bincount(last, minlength=len(b) + 1)
    return first, last, np.cumsum(change)[: len(b)] == 0


class Segments:
    """What is known of each distinct segment, by its place."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.valid = np.zeros(0, bool)
        #: Tokens of A and of B, groups and links.
        self.sizes = np.zeros((0, 4), np.int64)
        #: Groups as text, each with a semicolon after it.
        self.groups: list[str] = []
        self.pairs = np.zeros(0, np.int64)

    def add(self, new: list[str], valid: np.ndarray, sizes: np.ndarray, groups: list[str], pairs: np.ndarray) -> None:
        self.place.update(zip(new, range(len(self.groups), len(self.groups) + len(new)), strict=True))
        self.valid, self.sizes = np.concatenate([self.valid, valid]), np.concatenate([self.sizes, sizes])
        self.pairs = np.concatenate([self.pairs, pairs])
        self.groups += groups


class Aligner:
    def __init__(self, a: str, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = TokenizerA(a), TokenizerB(b)
        self.size = [np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b)]
        # An id as text with what follows it: inside a group, and at the end of its side of a group.
        self.inside, self.last = ([np.array([f"{i}{end}" for i in range(len(t.bytes))], object) for t, end in ends] for ends in (((self.a, ","), (self.b, ",")), ((self.a, "|"), (self.b, ";"))))
        self.cut = segments if self.b.segmentable() else lambda text: [text]
        self.known = Segments()

    def forget(self) -> None:
        """Keeps the number of segments in memory bounded, between batches."""
        if len(self.known.groups) > CACHED:
            self.known = Segments()

    def encode_each(self, new: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of A and how many each segment has, the same for B, none for a segment that either does not give back as it is;
        and which segments they do."""
        ids = [t.encode(new) for t in (self.a, self.b)]
        valid = [all(b"".join([t.bytes[i] for i in x]) == s.encode() for t, x in zip((self.a, self.b), (x, y), strict=True)) for s, x, y in zip(new, *ids, strict=True)]
        kept = [[x if v else [] for x, v in zip(side, valid, strict=True)] for side in ids]
        return [np.array(x, np.int64) for side in kept for x in (list(chain.from_iterable(side)), [len(y) for y in side])], valid

    def encode_joined(self, new: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """The same for segments that may stand one after the other: as one string, which spares both libraries much of a call's work."""
        whole, ends, found = "".join(new), np.cumsum([len(s.encode()) for s in new]), []
        for t, size in zip((self.a, self.b), self.size, strict=True):
            ids = t.encode([whole])[0]
            reached = np.cumsum(size[ids])
            at = np.searchsorted(reached, ends)
            if b"".join([t.bytes[i] for i in ids]) != whole.encode() or (reached[np.minimum(at, len(ids) - 1)] != ends).any():
                return self.encode_each(new)
            found += [np.array(ids, np.int64), np.diff(at, prepend=-1)]
        return found, [True] * len(new)

    def learn(self, new: list[str]) -> None:
        odd = [s for s in new if not (s[0] in " \n" and len(s) > 1 and is_visible(s[1]) and is_visible(s[-1]))]
        plain, found, valid, order = new, [], [], []
        if odd:
            apart = set(odd)
            plain = [s for s in new if s not in apart]
        for encode, strings in ((self.encode_joined, plain), (self.encode_each, odd)):
            for part in runs(strings):
                ids, good = encode(part)
                found.append(ids)
                valid += good
                order += part
        a_ids, a_count, b_ids, b_count = (np.concatenate(x) for x in zip(*found, strict=True))
        first, last, ends = overlaps(self.size[0][a_ids], self.size[1][b_ids])
        counts = last - first + 1
        pairs = np.repeat(a_ids * WIDTH, counts) + gather(b_ids, first, counts)
        # Tokens in the order of their groups, A's before B's; an A token's group is that of the first B token it overlaps.
        b_group = np.cumsum(ends) - ends
        a_group = b_group[first]
        a_ends = np.append(a_group[1:] != a_group[:-1], True)[: len(a_group)]
        sort = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        texts = np.concatenate([np.where(e, self.last[k][ids], self.inside[k][ids]) for k, (ids, e) in enumerate(((a_ids, a_ends), (b_ids, ends)))])[sort].tolist()
        a_to, b_to = (np.concatenate(([0], np.cumsum(n))) for n in (a_count, b_count))
        cuts = (a_to + b_to).tolist()
        links = np.diff(np.concatenate(([0], np.cumsum(counts)))[a_to])
        groups = np.diff(np.concatenate(([0], np.cumsum(ends)))[b_to])
        self.known.add(order, np.array(valid, bool), np.column_stack([a_count, b_count, groups, links]), ["".join(texts[p:q]) for p, q in zip(cuts, cuts[1:], strict=False)], pairs)

    def same_bytes(self, found: list[str]) -> bool:
        """Whether all segments together are what both tokenizers give back."""
        whole = "".join(found).encode()
        return all(b"".join([t.bytes[i] for ids in t.encode(found) for i in ids]) == whole for t in (self.a, self.b))

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The places of all texts' segments, one text after the other, and how many each text has: none for one without tokens."""
        cut = [self.cut(" " + t) if t else [] for t in texts]
        known = self.known.place
        new = [s for s in dict.fromkeys(chain.from_iterable(cut)) if s not in known]
        if new:
            self.learn(new)
        counts = np.array([len(x) for x in cut], np.int64)
        places = np.fromiter(map(known.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum()))
        if not self.known.valid[places].all():
            for k in np.unique(np.repeat(np.arange(len(cut)), counts)[~self.known.valid[places]]).tolist():
                if self.same_bytes(cut[k]):
                    raise ValueError("tokenizers change parts of a text and give back the whole")
                counts[k] = 0
            keep = np.repeat(counts > 0, [len(x) for x in cut])
            places = places[keep]
        for s in new:
            if len(s) > CACHED_CHARS:
                del known[s]
        return places, counts

    def strings(self, places: np.ndarray, counts: np.ndarray) -> list[str]:
        """The groups of each text as text."""
        names, to = list(map(self.known.groups.__getitem__, places.tolist())), np.cumsum(np.append(0, counts)).tolist()
        return ["".join(names[p:q])[:-1] for p, q in zip(to, to[1:], strict=False)]

    def links(self, places: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """text, pair and times: the distinct pairs of linked ids of each text, in order."""
        n = self.known.sizes[:, 3]
        flat = gather(self.known.pairs, starts_of(n)[places], n[places])
        text = np.repeat(np.repeat(np.arange(len(counts)), counts), n[places])
        return distinct(text, flat, np.ones(len(flat), np.int64))


def runs(strings: list[str]) -> Iterator[list[str]]:
    """Strings in runs of about JOINED_CHARS characters."""
    part = np.cumsum([len(s) for s in strings]) // JOINED_CHARS if strings else np.zeros(0, np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(strings)]
    yield from (strings[p:q] for p, q in zip(cuts, cuts[1:], strict=False) if p < q)


def distinct(text: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (text, pair) once, with the sum of times; in order."""
    order = np.lexsort([pair, text])
    text, pair, times = text[order], pair[order], times[order]
    starts = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (pair[1:] != pair[:-1]))[: len(text)])
    return text[starts], pair[starts], np.add.reduceat(times, starts) if len(starts) else times


_ALIGNERS: dict[int, Aligner] = {}


def _aligner(vocabularies) -> Aligner:
    """One for each worker; the known segments outlive a task."""
    key = hash(vocabularies)
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(*vocabularies)
    return _ALIGNERS[key]


def vocabularies(a: str | None = None, b: str | None = None) -> tuple[str, bytes]:
    """The contents of both files; the public ones unless paths are given."""
    import public_tokenizers

    with open(a or public_tokenizers.path(VOCABULARY_A), encoding="utf-8") as file, open(b or public_tokenizers.path(VOCABULARY_B), "rb") as model:
        return file.read(), model.read()


def align(docs: DataFrame, files: tuple[str, bytes]) -> DataFrame:
    """Adds groups: the A ids and B ids between two places where tokens of both end, in order."""
    shared = docs.sparkSession.sparkContext.broadcast(files)
    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != "groups"))
    ids = T.ArrayType(T.IntegerType())
    kind = T.ArrayType(T.StructType([T.StructField("a", ids), T.StructField("b", ids)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(shared.value)
        for batch in batches:
            for part in slices(batch):
                aligner.forget()
                texts = aligner.strings(*aligner.align(part.column("text").to_pylist()))
                groups = [[dict(zip("ab", ([int(i) for i in x.split(",")] for x in g.split("|")), strict=True)) for g in t.split(";")] if t else [] for t in texts]
                pair = pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(groups, pa.list_(pair))], names=[*part.schema.names, "groups"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("groups", kind)]))


_SIZES = ("n_a", "n_b", "n_groups", "n_links")


def _packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Each text's values as the bytes of 32-bit integers: one value a row for Spark to carry, not thousands."""
    ends = pa.py_buffer((4 * np.cumsum(np.append(0, counts))).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, ends, pa.py_buffer(values.astype(np.int32))])


def linked(docs: DataFrame, files: tuple[str, bytes]) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256; a, b and times: the distinct pairs of linked ids, packed.  A row for each of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(shared.value)
        for batch in batches:
            for part in slices(batch):
                aligner.forget()
                places, counts = aligner.align(part.column("text").to_pylist())
                whose = np.repeat(np.arange(len(counts)), counts)
                sizes = [np.bincount(whose, c, len(counts)).astype(np.int64) for c in aligner.known.sizes[places].T]
                digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in aligner.strings(places, counts)]
                text, pair, times = aligner.links(places, counts)
                n = np.bincount(text, minlength=len(counts))
                made = [part.column("doc_id"), *map(pa.array, sizes), pa.array(digests, pa.string()), *(_packed(x, n) for x in (pair // WIDTH, pair % WIDTH, times))]
                yield pa.RecordBatch.from_arrays(made, names=["doc_id", *_SIZES, "groups_sha256", "a", "b", "times"])

    schema = ", ".join(["doc_id long", *(f"{c} long" for c in _SIZES), "groups_sha256 string", "a binary", "b binary", "times binary"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _pairs_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, pair and times of a batch of linked() rows."""
    a, b, times = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int32).astype(np.int64) for c in ("a", "b", "times"))
    n = pc.binary_length(batch.column("a")).to_numpy(zero_copy_only=False) // 4
    return np.repeat(np.arange(batch.num_rows), n), a * WIDTH + b, times


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(k, ROWS_AT_ONCE)


def link_counts(rows: DataFrame) -> DataFrame:
    """pair and n, how many links of all texts hold it; combined in the tasks first.  rows: linked(), stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            _, pair, times = _pairs_of(batch)
            _, pair, n = distinct(np.zeros(len(pair), np.int64), pair, times)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

    return rows.select("a", "b", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def with_best(counts: DataFrame) -> DataFrame:
    """Adds is_best: whether no pair of the same B id has a higher count."""
    b = F.pmod("pair", F.lit(WIDTH))
    best = F.broadcast(counts.groupBy(b.alias("b")).agg(F.max("n").alias("best")))
    return counts.withColumn("b", b).join(best, "b").select("pair", "n", (F.col("n") == F.col("best")).alias("is_best"))


def hot_pairs(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted pairs, n and is_best of the pairs with more than one in HOT_LINKS of all links: fewer than HOT_LINKS."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.filter(F.col("n") * HOT_LINKS > total).toArrow().sort_by("pair")
    return tuple(rows.column(c).to_numpy() for c in ("pair", "n", "is_best"))


def scores(rows: DataFrame, hot: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """row, n_best and count_sum of its hot pairs, and rest: its other pairs.  rows: row and the lists of linked()."""
    shared = rows.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_pair, n, is_best = shared.value
        for batch in parts(batches):
            text, pair, times = _pairs_of(batch)
            found = np.minimum(np.searchsorted(hot_pair, pair), max(len(hot_pair) - 1, 0))
            is_hot = hot_pair[found] == pair if len(hot_pair) else np.zeros(len(pair), bool)
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            for out, values in zip(sums, (is_best, n), strict=True):
                np.add.at(out, text[is_hot], times[is_hot] * values[found[is_hot]])
            cold = pa.StructArray.from_arrays([pa.array(pair[~is_hot]), pa.array(times[~is_hot])], ["pair", "times"])
            ends = np.cumsum(np.append(0, np.bincount(text[~is_hot], minlength=batch.num_rows)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), *map(pa.array, sums), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cold)], names=["row", "n_best", "count_sum", "rest"])

    return rows.select("row", "a", "b", "times").mapInArrow(run, "row long, n_best long, count_sum long, rest array<struct<pair: long, times: long>>")


def alignment(docs: DataFrame, files: tuple[str, bytes]) -> DataFrame:
    """doc_id and the counts of the text's tokens, groups and links, a row for each of docs."""
    spark, place = docs.sparkSession, new_folder(docs.sparkSession, "links")
    linked(docs, files).withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{place}/links")
    links = spark.read.parquet(f"{place}/links")
    with_best(link_counts(links)).write.parquet(f"{place}/counts")
    counts = spark.read.parquet(f"{place}/counts")
    scores(links, hot_pairs(counts)).write.parquet(f"{place}/scores")
    scored = spark.read.parquet(f"{place}/scores")
    rest = scored.select("row", F.explode("rest").alias("of")).select("row", "of.*").join(counts, "pair")
    rest = rest.select("row", F.when(F.col("is_best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    sums = scored.select("row", "n_best", "count_sum").unionByName(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return links.join(sums, "row").select("doc_id", *_SIZES, "n_best", "count_sum", "groups_sha256")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabularies())
