"""Lexical retrieval packing: a sharded BM25 index fills each window with neighbours of its seed.

Documents are tokenised once and kept as 16-bit ids. Corpus statistics (number
of documents, mean length, document frequency of each vocabulary id) cover all
documents and are bounded by the vocabulary. Documents are dealt out by topic,
then by a MinHash over their rarer ids, then by document id, so that related
texts meet in a partition; documents of a key that fills several partitions
take turns among them. Topics are
centroids of random projections of the BM25 weights, fitted on a bounded sample
(``SAMPLE`` documents, about); every document is projected whole. A partition is
read as a run of shards of bounded size; each has its own inverted index. The
first unused document is the seed, BM25 over all its terms ranks the unused
rest of the shard, and these fill the window in that order, for as long as it is
open and any of them shares a term; a document that does not fit is cut, and its
rest seeds the next window. A window that a document closes without a rest is
followed by one that the best unused neighbour seeds. A window left open at the end of
a shard goes on in the next one, and what is left at the end of a partition is
cut into powers of two, which need no padding.

Defined cases: a null or empty text is the end id alone; repeated rows are
packed each for itself; a text longer than a window fills several; an empty
table gives an empty result; of neighbours whose scores agree to two decimals the
earlier in the shard's order (topic, MinHash, then id) goes first; only the id and text columns are
read, so other columns and their names do not matter.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, small_batches

WINDOW = 4096
END_ID = 2
VOCABULARY = 1 << 16
#: Ids that share one index.
SHARD_IDS = 1 << 22
#: Ids that one partition holds, about.
PARTITION_IDS = 1 << 26
#: Ids that one partition holds at least, about, if the table has as many.
LEAST_IDS = 1 << 21
K1, B = 1.2, 0.75
#: Documents, about, on which topics and the bounds of partitions are fitted; topics; numbers in a sketch.
SAMPLE, TOPICS, SKETCH = 8192, 256, 64
#: Distinct words, characters of these, and chunks of other texts, whose ids a worker remembers.
CACHE_WORDS, CACHE_CHARS, CACHE_CHUNKS = 400_000, 16 << 20, 100_000
#: Characters that are tokenised in one step.
STEP_CHARS = 6 << 20

#: Counts of a task, as rows of a term and a number.
COUNTS = pa.list_(pa.struct([("term", pa.int32()), ("n", pa.int64())]))
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Characters that str.split() takes for white space, and the tokenizer does not.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Texts that Arrow does not split: beyond Latin characters, case folding or normal forms may join or split what a
#: pattern sees; an apostrophe may begin a contraction; special tokens hold "<|".
_NOT_PLAIN = "[^\\t-\\r -&(-~\u00a0-\u00ff]|<[|]"
#: What the tokenizer sets apart in lower-cased text of the other characters: marks in runs, digits one by one. Fixed values.
_APART = "([^a-zªµºß-öø-ÿ0-9²³¹¼½¾\\s\u00a0]+|[0-9²³¹¼½¾])"
WORD_END = "</w>"


@lru_cache(maxsize=1)
def _tokenizers(path: str) -> tuple:
    """The tokenizer, one for words that are set apart and in lower case already, and which ids end a word; loaded once in a worker."""
    from tokenizers import Tokenizer, pre_tokenizers

    whole, plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
    plain.normalizer = None
    plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    size = whole.get_vocab_size(with_added_tokens=True)
    return whole, plain, np.array([(whole.id_to_token(i) or "").endswith(WORD_END) for i in range(size)])


class WordTokenizer:
    """Ids of a text by its words, whose ids do not depend on their neighbours.

    Texts in Latin characters are split as the tokenizer splits them. Others,
    those with apostrophes and those that hold something like a special token
    are split at white space only; those with control characters that count as
    white space here and not there are given to the tokenizer whole.
    """

    def __init__(self, path: str):
        self.tokenizer, self.plain, self.ends = _tokenizers(path)
        #: Places of known words in the pool of their ids, in its order; the first is the empty word, which has none.
        self.known: dict[str, int] = {"": 0}
        self.pool, self.stops = np.zeros(0, dtype="<u2"), np.zeros(1, dtype=np.int64)
        #: Steps that met each known word.
        self.met = np.zeros(1, dtype=np.int64)
        self.chars = 0
        self.strange: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u2")

    def of_fresh(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in one call, and where each word's end: its last id tells."""
        (e,) = self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)
        ids = np.array(e.ids, dtype="<u2")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):
            each = [self.ids(w) for w in words]
            ids, stops = np.concatenate(each), np.cumsum(list(map(len, each)))
        return ids, stops

    def forget(self) -> None:
        """Keep the words that more than one step met, unless they are too many themselves."""
        keep = self.met > 1
        if np.count_nonzero(keep) > CACHE_WORDS // 2:
            keep[:] = False
        keep[0] = True
        kept = self.listed().filter(pa.array(keep))
        words = list(compress(self.known, keep.tolist()))
        self.known, self.met, self.chars = dict(zip(words, range(len(words)))), np.zeros(len(words), dtype=np.int64), sum(map(len, words))
        self.pool, self.stops = np.asarray(kept.values), np.asarray(kept.offsets)[1:].astype(np.int64)
        if self.chars > CACHE_CHARS // 2:
            self.known, self.met, self.chars = {"": 0}, self.met[:1], 0
            self.pool, self.stops = self.pool[:0], self.stops[:1]

    def listed(self) -> pa.ListArray:
        """The pool as a list of ids for each known word."""
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], self.stops)), pa.int32()), pa.array(self.pool, pa.uint16()))

    def of_words(self, words: np.ndarray) -> np.ndarray:
        """Places in the pool of distinct words; many unknown ones are tokenised in one call."""
        if len(self.known) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.forget()
        at = np.fromiter(map(self.known.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            new = words[fresh].tolist()
            at[fresh] = np.arange(len(self.known), len(self.known) + len(new))
            self.known.update(zip(new, at[fresh].tolist()))
            self.chars += sum(map(len, new))
            pool, stops, size = [self.pool], [self.stops], len(self.pool)
            for a in range(0, len(new), 4096):
                ids, ends = self.of_fresh(new[a : a + 4096])
                pool.append(ids)
                stops.append(ends + size)
                size += len(ids)
            self.pool, self.stops = np.concatenate(pool), np.concatenate(stops)
            self.met = np.concatenate((self.met, np.zeros(len(new), dtype=np.int64)))
        self.met[at] += 1
        return at

    def other(self, text: str) -> bytes:
        """Ids of a text beyond Latin characters, or with something like a special token."""
        if _ODD_SPACE.search(text):
            return self.ids(text).tobytes()
        chunks = text.split()
        fresh = list({c for c in chunks if c not in self.strange})
        if len(self.strange) + len(fresh) > CACHE_CHUNKS:
            self.strange.clear()
            fresh = list(set(chunks))
        for chunk, e in zip(fresh, self.tokenizer.encode_batch(fresh, add_special_tokens=False)):
            self.strange[chunk] = np.array(e.ids, dtype="<u2").tobytes()
        return b"".join(map(self.strange.__getitem__, chunks))

    def of_lists(self, lists: pa.ListArray) -> list[bytes]:
        """Ids of texts given as lists of words; only distinct words are looked up, and ids are laid out by place."""
        coded = lists.flatten().dictionary_encode()
        at = self.of_words(coded.dictionary.to_numpy(zero_copy_only=False))
        by_word = self.listed().take(pa.array(at[np.asarray(coded.indices)]))
        bounds = 2 * np.asarray(by_word.offsets)[np.asarray(lists.offsets) - lists.offsets[0].as_py()].astype(np.int64)
        raw = memoryview(np.asarray(by_word.values).tobytes())
        return [bytes(raw[x:y]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text of a string array; plain texts are split in Arrow."""
        texts = pc.fill_null(texts, "")
        plain = pc.invert(pc.match_substring_regex(texts, _NOT_PLAIN))
        apart = pc.replace_substring_regex(pc.utf8_lower(texts.filter(plain)), _APART, r" \1 ")
        done = iter(self.of_lists(pc.utf8_split_whitespace(apart)))
        return [next(done) if ok else self.other(t.as_py()) for ok, t in zip(plain.to_pylist(), texts)]


def _steps(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of a few million characters, at least one text each."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.utf8_length(texts), 0)))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP_CHARS)))
        yield texts.slice(at, stop - at)
        at = stop


def distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and their counts; 16-bit numbers are sorted by radix."""
    ordered = np.sort(ids, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[first], np.diff(first, append=len(ids))


class Frequencies:
    """How many documents hold each vocabulary id, the number of documents, and of their ids."""

    def __init__(self):
        self.df, self.docs, self.size = np.zeros(VOCABULARY, dtype=np.int64), 0, 0
        self.seen = np.zeros(VOCABULARY, dtype=bool)

    def add(self, ids: np.ndarray) -> None:
        if len(ids) > 1024:  # marks are cheaper than sorting
            self.seen[ids] = True
            self.df += self.seen
            self.seen[ids] = False
        else:
            self.df[distinct(ids)[0]] += 1
        self.docs += 1
        self.size += len(ids)

    def rows(self) -> list[dict]:
        """Counts by term; -1 stands for the documents, -2 for their ids."""
        at = np.flatnonzero(self.df)
        terms, counts = [*at.tolist(), -1, -2], [*self.df[at].tolist(), self.docs, self.size]
        return [{"term": t, "n": n} for t, n in zip(terms, counts)]


def document_frequencies(tokens: DataFrame) -> tuple[np.ndarray, int, float]:
    """df of each vocabulary id, number of documents, mean length: the counts of all tasks, summed by Spark."""
    df = np.zeros(VOCABULARY, dtype=np.int64)
    docs = size = 0
    counts = tokens.where("counts is not null").select(F.inline("counts"))
    for term, n in counts.groupBy("term").agg(F.sum("n")).collect():
        if term == -1:
            docs = n
        elif term == -2:
            size = n
        else:
            df[term] = n
    return df, docs, size / max(1, docs)


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids, counts)``: ids as little-endian 16-bit numbers, the end id last, with null counts; and for
    each task a row with null ids and its counts (``Frequencies.rows``), so that they are taken in the same pass."""
    small_batches(docs.sparkSession)
    end = np.array([end_id], dtype="<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, seen = WordTokenizer(tokenizer_path), Frequencies()
        for batch in batches:
            at = 0
            for texts in _steps(batch.column("text")):
                ids = [x + end for x in tokenizer.encode(texts)]
                for raw in ids:
                    seen.add(np.frombuffer(raw, dtype="<u2"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.array(ids, pa.binary()), pa.nulls(len(ids), COUNTS)], ["doc_id", "ids", "counts"])
                at += len(texts)
            pa.default_memory_pool().release_unused()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([seen.rows()], COUNTS)], ["doc_id", "ids", "counts"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary, counts array<struct<term: int, n: long>>")


def bm25(idf: np.ndarray, tf: np.ndarray, length: np.ndarray | int, mean: float) -> np.ndarray:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / np.float32(mean)))


@lru_cache(maxsize=1)
def _axes() -> np.ndarray:
    """A random direction for each vocabulary id, the same in every worker."""
    return np.clip(np.rint(32 * np.random.default_rng(1).standard_normal((VOCABULARY, SKETCH), dtype=np.float32)), -127, 127).astype(np.int8)


def sketch(ids: np.ndarray, idf: np.ndarray, mean: float) -> np.ndarray:
    """A random projection of a whole document's BM25 weights: whole numbers below 2**35, so that sums are exact in any order."""
    term, tf = distinct(ids)
    return np.rint(64 * bm25(idf[term], tf.astype(np.float32), len(ids), mean)).astype(np.float64) @ _axes()[term].astype(np.float64)


class Topics:
    """Centroids of document sketches, in an order in which each is followed by its nearest of the rest.

    Middle and centroids are whole numbers, and so are the products with
    sketches (below 2**53): a repeated task finds the same topics again.
    """

    def __init__(self, sketches: np.ndarray, count: int = TOPICS, rounds: int = 10):
        rows = np.unique(sketches, axis=0)  # copies count once
        self.middle = np.rint(rows.mean(axis=0))
        rows = unit(rows - self.middle)
        centroids = rows[np.random.default_rng(0).choice(len(rows), min(count, len(rows)), replace=False)]
        for _ in range(rounds):
            nearest = np.argmax(rows @ centroids.T, axis=1)
            for t in np.unique(nearest):
                centroids[t] = rows[nearest == t].mean(axis=0)
            centroids = unit(centroids)
        rest, chain = np.ones(len(centroids), dtype=bool), [0]
        while len(chain) < len(centroids):
            rest[chain[-1]] = False
            chain.append(int(np.argmax(np.where(rest, centroids @ centroids[chain[-1]], -np.inf))))
        self.centroids = np.rint(1024 * centroids[chain])

    def of(self, sketches: np.ndarray) -> np.ndarray:
        """The topic of each document."""
        return np.argmax((sketches - self.middle) @ self.centroids.T, axis=1)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


#: A draw of 31 bits for each vocabulary id.
_DRAW = ((np.arange(VOCABULARY, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)


def min_hash(ids: np.ndarray, rare: np.ndarray) -> int:
    """The least draw of a document's rarer ids, or of all where it has none."""
    some = ids[rare[ids]]
    return int(_DRAW[some if len(some) else ids].min())


def bounds_of(keys: np.ndarray, sizes: np.ndarray, partitions: int) -> np.ndarray:
    """Keys that cut documents like the given ones into partitions of about equal size; a key that fills several is repeated."""
    order = np.argsort(keys, kind="stable")
    reached = np.cumsum(sizes[order])
    return np.interp(reached[-1] * np.arange(1, partitions) / partitions, reached, keys[order]).astype(np.int64)


def part_of(keys: np.ndarray, bounds: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Partition of each key; documents of a key that fills several take turns."""
    first, last = np.searchsorted(bounds, keys, "left"), np.searchsorted(bounds, keys, "right")
    return first + turn % (last - first + 1)


def deal(tokens: DataFrame, idf: np.ndarray, rare: np.ndarray, docs: int, mean: float, partitions: int) -> DataFrame:
    """``(doc_id, ids)`` dealt out by topic and MinHash, and sorted by these and the id.

    Topics and bounds come from about ``SAMPLE`` documents, chosen by a hash of
    id and ids; only their sketches, MinHashes and sizes reach the driver. A
    task that is repeated deals its rows as before.
    """

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.frombuffer(raw, dtype="<u2") for raw in batch.column("ids").to_pylist()]
            columns = [pa.array([sketch(ids, idf, mean).tobytes() for ids in each], pa.binary()), pa.array([min_hash(ids, rare) for ids in each], pa.int64()), pa.array(list(map(len, each)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["sketch", "low", "size"])

    rows = tokens.where("ids is not null").select("doc_id", "ids")
    share = int(min(1.0, SAMPLE / max(1, docs)) * (1 << 31))
    sample = rows.where(F.shiftrightunsigned(F.xxhash64("doc_id", "ids"), 33) < share).select("ids")
    found = sample.mapInArrow(drawn, "sketch binary, low long, size long").limit(2 * SAMPLE).toArrow()
    if not found.num_rows:
        topics, bounds = None, np.zeros(0, dtype=np.int64)
    else:
        sketches = np.frombuffer(b"".join(found.column("sketch").to_pylist()), dtype=np.float64).reshape(-1, SKETCH)
        topics = Topics(sketches)
        bounds = bounds_of((topics.of(sketches) << 31) + np.asarray(found.column("low")), np.asarray(found.column("size")), partitions)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for batch in batches:
            each = [np.frombuffer(raw, dtype="<u2") for raw in batch.column("ids").to_pylist()]
            keys = np.array([min_hash(ids, rare) for ids in each], dtype=np.int64)
            if topics is not None and each:
                keys += topics.of(np.stack([sketch(ids, idf, mean) for ids in each])) << 31
            part = part_of(keys, bounds, np.arange(turn, turn + len(each)))
            turn += len(each)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(keys), pa.array(part.astype(np.int32))], ["doc_id", "ids", "key", "part"])

    dealt = rows.mapInArrow(keyed, "doc_id long, ids binary, key long, part int").repartitionById(partitions, F.col("part"))
    return dealt.sortWithinPartitions("key", "doc_id").select("doc_id", "ids")


class Shard:
    """The BM25 inverted index of some documents, of which used ones drop out: whenever half are used, the index is cut to the rest.

    Terms that an eighth of the documents hold, or more, have their postings as
    rows over all documents, which are added whole: at most eight times the
    room of the postings.
    """

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        terms, counts = zip(*map(distinct, docs))
        sizes = np.fromiter(map(len, terms), dtype=np.int64, count=len(docs))
        doc = np.repeat(np.arange(len(docs)), sizes)
        term, tf = np.concatenate(terms), np.concatenate(counts).astype(np.float32)
        length = np.fromiter(map(len, docs), dtype=np.float32, count=len(docs))[doc]
        weight = bm25(idf[term], tf, length, mean)
        held = np.bincount(term, minlength=VOCABULARY)
        often = np.flatnonzero(held * 8 >= len(docs))
        row = np.full(VOCABULARY, -1)
        row[often] = np.arange(len(often))
        at = row[term]  # -1 for other terms
        self.rows = np.zeros((len(often), len(docs)), dtype=np.float32)
        self.rows[at[at >= 0], doc[at >= 0]] = weight[at >= 0]
        doc, term, weight = doc[at < 0], term[at < 0], weight[at < 0]
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order].astype(np.float64)
        self.starts = np.zeros(VOCABULARY + 1, dtype=np.int64)
        np.cumsum(np.bincount(term, minlength=VOCABULARY), out=self.starts[1:])
        self.row, self.terms = row, terms
        self.free = np.ones(len(docs), dtype=bool)
        #: The documents that the index covers.
        self.live = np.arange(len(docs))

    def shrink(self) -> None:
        """Leave out what is used."""
        keep = self.free[self.live]
        number = np.cumsum(keep) - 1
        self.live, self.rows = self.live[keep], self.rows[:, keep]
        stay = keep[self.doc]
        self.starts = np.concatenate(([0], np.cumsum(stay)))[self.starts]
        self.doc, self.weight = number[self.doc[stay]], self.weight[stay]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of each live document for all terms of ``seed``."""
        row = self.row[self.terms[seed]]
        asked = np.zeros(len(self.rows), dtype=np.float32)
        asked[row[row >= 0]] = 1
        score = asked @ self.rows
        rest = self.terms[seed][row < 0]
        if len(rest):
            at = [slice(a, b) for a, b in zip(self.starts[rest].tolist(), self.starts[rest.astype(np.int64) + 1].tolist())]
            score = score + np.bincount(np.concatenate([self.doc[s] for s in at]), np.concatenate([self.weight[s] for s in at]), minlength=len(score))
        return score

    def neighbours(self, seed: int, most: int = 64) -> np.ndarray:
        """The best ``most`` unused documents that share a term with ``seed``, best first, ties to the earlier; a caller with room for more asks again."""
        if 2 * np.count_nonzero(self.free[self.live]) < len(self.live):
            self.shrink()
        score = self.scores(seed)
        score[~self.free[self.live]] = 0
        hits = np.flatnonzero(score)
        score = np.round(score[hits], 2)  # sums in single precision agree so far
        if len(hits) > most:
            least = np.partition(score, len(hits) - most)[len(hits) - most]
            hits, score = hits[score >= least], score[score >= least]
        return self.live[hits[np.argsort(-score, kind="stable")][:most]]


class Windows:
    """Cuts documents into windows of one partition and numbers the sequences."""

    def __init__(self, partition: int, window: int):
        self.next, self.window = partition << 32, window
        self.open: list[list] = []
        self.used = 0
        self.rows: list[tuple] = []

    def put(self, doc_id, ids: np.ndarray, start: int) -> int:
        """Put what fits of ``ids`` from ``start`` into the open window; the new start."""
        end = min(len(ids), start + self.window - self.used)
        self.open.append([doc_id, ids, start, end])
        self.used += end - start
        if self.used == self.window:
            self.close(self.open)
            self.open, self.used = [], 0
        return end

    def close(self, pieces: list[list]) -> None:
        offset = 0
        for doc_id, ids, a, b in pieces:
            self.rows.append((doc_id, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()), len(ids), self.next, offset))
            offset += b - a
        self.next += 1

    def finish(self) -> None:
        """Cut the open rest into sequences of descending powers of two."""
        while self.used:
            room = 1 << (self.used.bit_length() - 1)
            self.used -= room
            taken = []
            while room:
                doc_id, ids, a, b = self.open[0]
                n = min(room, b - a)
                taken.append([doc_id, ids, a, a + n])
                room -= n
                self.open[0][2] += n
                if a + n == b:
                    self.open.pop(0)
            self.close(taken)

    def take(self) -> pd.DataFrame:
        rows, self.rows = self.rows, []
        out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        return out.astype({"doc_id": "Int64"})


def pack_shard(docs: list[tuple], windows: Windows, idf: np.ndarray, mean: float) -> None:
    shard = Shard([ids for _, ids in docs], idf, mean)

    def place(doc: int) -> bool:
        """Put a whole document; whether it was cut."""
        shard.free[doc] = False
        doc_id, ids = docs[doc]
        start = first = windows.put(doc_id, ids, 0)
        while start < len(ids):
            start = windows.put(doc_id, ids, start)
        return first < len(ids)

    for seed in range(len(docs)):
        if not shard.free[seed]:
            continue
        place(seed)
        doc = seed
        while len(near := shard.neighbours(doc)):
            if not windows.used:  # the best neighbour seeds the next window
                doc = int(near[0])
                place(doc)
                continue
            for other in near.tolist():
                if place(other):  # its rest seeds the next window
                    doc = other
                    break
                if not windows.used:
                    break


def pack(tokens: DataFrame, window: int = WINDOW, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Pieces of all documents of ``tokens`` (see ``tokenize``) in sequences of ``window`` ids."""
    df, docs, mean = document_frequencies(tokens)
    idf = np.log1p((docs - df + 0.5) / (df + 0.5)).astype(np.float32)
    rare = (df > 0) & (df <= max(2, docs // 20))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        windows = Windows(TaskContext.get().partitionId(), window)
        block: list[tuple] = []
        size = 0
        for batch in batches:
            for doc_id, raw in zip(batch["doc_id"].tolist(), batch["ids"]):
                ids = np.frombuffer(raw, dtype="<u2")
                block.append((None if pd.isna(doc_id) else int(doc_id), ids))
                size += len(ids)
                if size >= shard_ids:
                    pack_shard(block, windows, idf, mean)
                    block, size = [], 0
                    yield windows.take()
        if block:
            pack_shard(block, windows, idf, mean)
        windows.finish()
        yield windows.take()

    shuffle = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(1, min(shuffle, int(docs * mean) // LEAST_IDS), int(docs * mean) // PARTITION_IDS)
    return deal(tokens, idf, rare, docs, mean, partitions).mapInPandas(run, PIECES)


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise ``docs`` once, keep the ids in the shared folder, and pack them."""
    return pack(materialize(tokenize(docs, tokenizer_path, id_col=id_col, text_col=text_col)), window)
