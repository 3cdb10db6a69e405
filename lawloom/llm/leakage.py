"""Passages of evaluation items inside training documents."""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Sequence
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawloom.llm.mojibake import corpus_model, restore
from lawloom.session import balanced, materialize

#: Consecutive words that make a leak.
LEAST = 12
#: Words of a passage; passages overlap by LEAST - 1 words, so every run of LEAST words lies in one whole.
PASSAGE = 96
#: Items of a block of postings, and items of a shard (more items are searched in shards, one after another).
BLOCK, SHARD = 4, 20_000
#: Passages that are searched for at once, and bits of the table of words of a list in shards.
AT_ONCE, KNOWN_BITS = 1024, 1 << 24
K1, B = 1.2, 0.75
_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile(r"[̀-ͯ]")
_HIDDEN = re.compile("[­​-‏⁠﻿]")


def words(text: str) -> list[str]:
    """Runs of letters and digits, without case, accents and hidden characters."""
    if text.isascii():
        return _WORD.findall(text.lower())
    text = _MARKS.sub("", unicodedata.normalize("NFKD", _HIDDEN.sub("", text).lower()))
    return _WORD.findall(text)


def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all the ranges, and for each the range it is from."""
    n = stop - start
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) + np.repeat(start - np.cumsum(n) + n, n), of


class Index:
    """BM25 inverted index of items with block maxima, searched by block-max WAND.

    An item's weights are divided by the least score that a run of ``LEAST`` of its words can have, so a score of 1 is
    each item's own threshold: a passage that holds such a run scores at least 1, and none below is a leak. Items that
    share many words are numbered next to each other, which keeps the bounds of their blocks low.
    """

    def __init__(self, items: Iterable[tuple[int, str]], least: int = LEAST):
        self.least = least
        split = [(i, words(t)) for i, t in items if t]
        split = _alike_first([(i, ws) for i, ws in split if len(ws) >= least])
        self.ids = [i for i, _ in split]
        texts = [ws for _, ws in split]
        self.vocabulary = {w: n for n, w in enumerate(dict.fromkeys(w for ws in texts for w in ws))}
        coded = [[self.vocabulary[w] for w in ws] for ws in texts]
        df = Counter(t for ts in coded for t in set(ts))
        mean = sum(map(len, coded)) / max(1, len(coded))
        term, item, weights = [], [], []
        #: Of each item its runs of ``least`` words and where they begin.
        self.runs: list[dict[tuple[int, ...], list[int]]] = []
        for at, ts in enumerate(coded):
            weight = {}
            for t, n in Counter(ts).items():
                idf = math.log(1 + (len(coded) - df[t] + 0.5) / (df[t] + 0.5))
                weight[t] = idf * n * (K1 + 1) / (n + K1 * (1 - B + B * len(ts) / mean))
            runs: dict[tuple[int, ...], list[int]] = {}
            for i in range(len(ts) - least + 1):
                runs.setdefault(tuple(ts[i : i + least]), []).append(i)
            low = min(sum(weight[t] for t in set(w)) for w in runs)
            self.runs.append(runs)
            term += weight
            item += [at] * len(weight)
            weights += [x / low for x in weight.values()]
        order = np.lexsort((item, term)) if term else np.zeros(0, np.int64)
        terms_, self.item, self.weight = (np.asarray(x, k)[order] for x, k in ((term, np.int64), (item, np.int64), (weights, np.float64)))
        # a block: the postings of one term for BLOCK items in a row
        self.size = -(-len(coded) // BLOCK)
        key = terms_ * max(1, self.size) + self.item // BLOCK
        key, first = np.unique(key, return_index=True)
        self.begin, self.end = first, np.append(first[1:], len(terms_)).astype(np.int64)
        self.block = key % max(1, self.size)
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.start = np.searchsorted(key // max(1, self.size), np.arange(len(self.vocabulary) + 1))
        #: Postings of the terms asked for so far, and those of them that were scored.
        self.asked = self.scored = 0

    def search(self, queries: Sequence[Iterable[int]], threshold: float = 1 - 1e-9) -> list[list[int]]:
        """For each query (its terms) all items that score at least ``threshold``.

        Block-max WAND with the pivots of all queries set together: a query's terms have a list of blocks each, whose
        maxima add up to an upper bound for every block of items. Where the bound stays below the threshold the lists
        skip the block; only the postings of the other blocks are read and scored.
        """
        out: list[list[int]] = [[] for _ in queries]
        step = max(1, (1 << 22) // max(1, self.size))
        for a in range(0, len(queries), step):
            part = [np.fromiter(set(q), np.int64) for q in queries[a : a + step]]
            sizes = [len(q) for q in part]
            if not sum(sizes):
                continue
            term, query = np.concatenate(part), np.repeat(np.arange(len(part)), sizes)
            block, of = _ranges(self.start[term], self.start[term + 1])
            place = query[of] * self.size + self.block[block]
            bound = np.bincount(place, self.most[block], len(part) * self.size)
            alive = bound >= threshold
            self.asked += int((self.end[block] - self.begin[block]).sum())
            kept = alive[place]
            block, place = block[kept], place[kept]
            number = np.cumsum(alive) - 1
            posting, of = _ranges(self.begin[block], self.end[block])
            self.scored += len(posting)
            slot = number[place[of]] * BLOCK + self.item[posting] % BLOCK
            score = np.bincount(slot, self.weight[posting], int(alive.sum()) * BLOCK)
            found = np.flatnonzero(score >= threshold)
            at = np.flatnonzero(alive)[found // BLOCK]
            for q, i in zip((at // self.size).tolist(), (at % self.size * BLOCK + found % BLOCK).tolist(), strict=True):
                out[a + q].append(i)
        return out

    def stretches(self, ws: Sequence[str]) -> list[list[int]]:
        """The words of a text by number, where at least ``least`` words of items stand in a row."""
        coded = np.fromiter(map(self.vocabulary.get, ws, repeat(-1)), np.int32, len(ws))
        breaks = np.flatnonzero(np.concatenate([[-1], coded, [-1]]) < 0)  # unknown words, and before the first and behind the last
        long = np.flatnonzero(np.diff(breaks) > self.least)
        return [coded[a : b - 1].tolist() for a, b in zip(breaks[long].tolist(), breaks[long + 1].tolist(), strict=True)]

    def longest(self, stretch: Sequence[int], at: int) -> int:
        """The most words in a row that a stretch has in common with an item; 0 if fewer than ``least``."""
        runs, least, best = self.runs[at], self.least, 0
        going: dict[int, tuple[int, int]] = {}  # by the distance between the places: where the run goes on, its length
        for i in range(len(stretch) - least + 1):
            for j in runs.get(tuple(stretch[i : i + least]), ()):
                next_, n = going.get(i - j, (-1, 0))
                n = n + 1 if next_ == i else least
                going[i - j] = (i + 1, n)
                best = max(best, n)
        return best

    def leaks(self, texts: Iterable[tuple[int, Sequence[str]]]) -> dict[tuple[int, int], int]:
        """``(key, item): n_words`` for texts by their words: each passage of a stretch asks the index, and what comes
        out is compared word by word with the whole stretch."""
        found: dict[tuple[int, int], int] = {}
        waiting: list[tuple[int, list[int]]] = []
        passages, of = [], []

        def ask() -> None:
            asked: dict[int, set[int]] = {}
            for n, hits in zip(of, self.search(passages), strict=True):
                asked.setdefault(n, set()).update(hits)
            for n, hits in asked.items():
                key, stretch = waiting[n]
                runs = {tuple(stretch[i : i + self.least]) for i in range(len(stretch) - self.least + 1)} if hits else set()
                for at in hits:
                    if not self.runs[at].keys().isdisjoint(runs):
                        place = (key, self.ids[at])
                        found[place] = max(found.get(place, 0), self.longest(stretch, at))
            waiting.clear()
            passages.clear()
            of.clear()

        for key, ws in texts:
            if len(ws) < self.least:
                continue
            for stretch in self.stretches(ws):
                for i in range(0, max(1, len(stretch) - self.least + 1), PASSAGE - self.least + 1):
                    passages.append(stretch[i : i + PASSAGE])
                    of.append(len(waiting))
                waiting.append((key, stretch))
            if len(passages) >= AT_ONCE:
                ask()
        ask()
        return found


def _alike_first(items: list[tuple[int, list[str]]]) -> list[tuple[int, list[str]]]:
    """Items in an order in which those with the same frequent words are neighbours."""
    often = Counter(w for _, ws in items for w in set(ws))
    rank = {w: n for n, (w, _) in enumerate(often.most_common())}
    return sorted(items, key=lambda x: (sorted(rank[w] for w in set(x[1])), x[0]))


def _found(batches, texts, index: Index):
    for b in batches:
        out = index.leaks(texts(b)).items()
        cols = zip(*((k, i, n) for (k, i), n in out), strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["key", "item_key", "n_words"])


def _word_bit(w: str) -> int:
    return zlib.crc32(w.encode()) % KNOWN_BITS


def _word_table(items: DataFrame) -> np.ndarray:
    """A bit for each word of any item, by its hash: what shares a bit only makes stretches longer."""

    def mark(batches):
        bits = np.zeros(KNOWN_BITS, bool)
        for b in batches:
            for t in b.column(0).to_pylist():
                for w in words(t):
                    bits[_word_bit(w)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    bits = np.zeros(KNOWN_BITS // 8, np.uint8)
    for r in items.select("t").mapInArrow(mark, "bits binary").toLocalIterator():
        bits |= np.frombuffer(bytes(r[0]), np.uint8)
    return np.unpackbits(bits).astype(bool)


def find_leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, least: int = LEAST, shard: int = SHARD, restored: bool = True) -> DataFrame:
    """``key, item_key, n_words``: each document that holds at least ``least`` consecutive words of an item.

    Wrongly decoded documents are restored first, unless ``restored`` is false. Every passage of every document that
    consists of words of the items is a query to a BM25 index of the items, from which a block-max WAND retrieves all
    above their thresholds; each is then verified word by word. The index goes to the tasks whole if there are at most
    ``shard`` items. Else documents are restored and cut to the stretches of item words once, and these are searched
    shard by shard. ``n_words`` is the longest run of words that document and item have in common.

    Defined cases: null and short texts hold nothing; an item of fewer than ``least`` words can't leak; case, accents,
    punctuation, spacing and line breaks don't count; repeated documents with one key give one row.
    """
    spark = docs.sparkSession
    held = items.select(F.col(item_key).cast("long").alias("k"), F.col(item_text).alias("t")).where(F.col("t").isNotNull()).distinct()
    shards = max(1, -(-held.count() // shard))
    if shards > 1:
        held = materialize(held, "items")
    words_of_items = F.explode(F.regexp_extract_all(F.lower("t"), F.lit(r"(\p{L}*[\p{L}&&[^\x00-\x7F]]\p{L}*)"), F.lit(1)))
    shared = spark.sparkContext.broadcast(corpus_model(docs, text, held.select(words_of_items.alias("w"))) if restored else None)
    rows = balanced(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where(F.length("text") >= 2 * least - 1))

    def texts(b):
        for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            yield k, words(restore(t, shared.value)[0] if restored else t)

    schema = "key long, item_key long, n_words long"
    if shards == 1:
        entries = spark.sparkContext.broadcast([tuple(r) for r in held.orderBy("k").collect()])
        found = rows.mapInArrow(lambda bs: _found(bs, texts, Index(entries.value, least)), schema)
        return found.groupBy("key", "item_key").agg(F.max("n_words").alias("n_words"))

    known = spark.sparkContext.broadcast(_word_table(held))

    def cut(batches):
        for b in batches:
            keys, kept = [], []
            for k, ws in texts(b):
                flags = np.concatenate([[False], known.value[np.fromiter(map(_word_bit, ws), np.int64, len(ws))], [False]])
                edges = np.flatnonzero(flags[1:] != flags[:-1]).tolist()
                for i, j in zip(edges[::2], edges[1::2], strict=True):
                    if j - i >= least:
                        keys.append(k)
                        kept.append(" ".join(ws[i:j]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(kept, pa.string())], names=["key", "words"])

    stretches = materialize(rows.mapInArrow(cut, "key long, words string"), "stretches")

    def stored(b):
        return zip(b.column(0).to_pylist(), (t.split(" ") for t in b.column(1).to_pylist()), strict=True)

    parts = []
    for n in range(shards):
        entries = spark.sparkContext.broadcast([tuple(r) for r in held.where(F.pmod(F.xxhash64("k"), F.lit(shards)) == n).orderBy("k").collect()])
        parts.append(stretches.mapInArrow(lambda bs, entries=entries: _found(bs, stored, Index(entries.value, least)), schema))
    return reduce(DataFrame.unionByName, parts).groupBy("key", "item_key").agg(F.max("n_words").alias("n_words"))


def answer_overlap(leaks: DataFrame, docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, answer: str) -> DataFrame:
    """``leaks`` with ``answer_share``: of the distinct words of the item's answer, the share that the document holds.

    For items of a question and an answer: ``find_leaks`` finds the question, and this tells whether the answer came
    with it. Only documents with a leak are read again. Null if the answer is null or has no words; of several rows with
    one key the largest share holds.
    """
    texts = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).join(leaks.select("key").distinct(), "key", "left_semi")
    answers = items.select(F.col(item_key).cast("long").alias("item_key"), F.col(answer).alias("answer")).dropDuplicates(["item_key"])
    pairs = leaks.select("key", "item_key").join(answers, "item_key", "left").join(texts, "key")

    def share(batches):
        for b in batches:
            out = []
            for a, t in zip(b.column("answer").to_pylist(), b.column("text").to_pylist(), strict=True):
                asked = set(words(a)) if a else set()
                out.append(len(asked & set(words(t))) / len(asked) if asked and t else None)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("item_key"), pa.array(out, pa.float64())], names=["key", "item_key", "share"])

    shares = pairs.mapInArrow(share, "key long, item_key long, share double").groupBy("key", "item_key").agg(F.max("share").alias("answer_share"))
    return leaks.join(shares, ["key", "item_key"], "left")
