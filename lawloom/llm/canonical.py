"""Mapping freely typed values to the entries of a reference list."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawloom.llm.bktree import BKTree
from lawloom.llm.lookalikes import fold
from lawloom.session import materialize, spread

#: Content words of the reference list that one task holds; the words of a longer list are searched in shards.
SHARD = 100_000
# Romanian connecting words, which are not content words, and endings of inflected nouns and adjectives.
CONNECTORS = frozenset("de din pentru la cu pe in si sau al a ale ai un o unui unei nr nr. pt".split())
ENDINGS = ("urilor", "elor", "ilor", "ului", "uri", "ele", "ile", "lor", "lui", "iei", "ul", "le", "ei", "ii", "i", "a", "e", "u", "l")

_TOKEN = re.compile(r"[a-z0-9]+\.?")
_CACHE = 1 << 20


def tokens(text: str) -> list[str]:
    """Content words of a folded text; an abbreviation keeps its full stop. Numbers and connectors are left out."""
    return [t for t in _TOKEN.findall(fold(text).replace("_", " ")) if t not in CONNECTORS and t.rstrip(".") not in CONNECTORS and not t[0].isdigit() and t != "."]


def stems(word: str) -> list[str]:
    """What is left of an inflected word without one of the endings."""
    return [word[: -len(e)] for e in ENDINGS if word.endswith(e) and len(word) - len(e) >= 3]


def allowed(word: str) -> int:
    """Edits within which a word counts as a spelling of another."""
    n = len(word)
    return 1 if n <= 4 else 2 if n <= 9 else 3


#: Kinds of hits: within the edits allowed, of the same stem, behind a full stop, a beginning without one.
EDIT, STEM, SHORT, BARE = range(4)
Hit = tuple[str, float, int]  # reference word, cost, kind


def settle(hits: Iterable[Hit]) -> dict[str, float]:
    """The reference words that a word stands for, with costs, from all hits there are for it in the whole list.

    A reference word as it is stands for itself alone. Beginnings without a full stop count only if there is nothing
    else. A word that is close to one reference word does not stand for another that is much farther.
    """
    hits = list(hits)
    if any(c == 0 for _, c, _ in hits):
        return {w: 0.0 for w, c, _ in hits if c == 0}
    hits = [h for h in hits if h[2] != BARE] or hits
    cost: dict[str, float] = {}
    for w, c, _ in hits:
        cost[w] = min(c, cost.get(w, c))
    least = min(cost.values(), default=0.0)
    return {w: c for w, c in cost.items() if c <= least + 1}


class Words:
    """Content words of a reference list: a BK-tree of them, one of their stems, and their beginnings."""

    def __init__(self, words: Iterable[str]):
        self.words = sorted(set(words))
        self.tree = BKTree(self.words)
        self.by_stem: dict[str, list[str]] = defaultdict(list)
        self.prefixes: dict[str, list[str]] = defaultdict(list)
        for w in self.words:
            for s in {w, w[:-1] if w[-1] in "aeiu" and len(w) >= 4 else w}:
                self.by_stem[s].append(w)
            for n in range(2, len(w) + 1):
                self.prefixes[w[:n]].append(w)
        self.stem_tree = BKTree(sorted(self.by_stem))

    def hits(self, asked: Sequence[str]) -> list[list[Hit]]:
        """For each word every reference word within its threshold. What is found does not depend on other words of the
        list, so hits of the shards of a list are the hits of the list."""
        found: list[list[Hit]] = [[] for _ in asked]
        bare = [w.rstrip(".") for w in asked]
        for q, n, d in zip(*self.tree.search(bare, [allowed(w) for w in bare]), strict=True):
            u, v = bare[q], self.words[n]
            # two edits in a short word: letters in another order, else it is another word
            if d < 2 or min(len(u), len(v)) > 5 or sorted(u) == sorted(v):
                found[q].append((v, float(d), EDIT))
        cut = [(i, s) for i, w in enumerate(bare) for s in stems(w)]
        for q, n, d in zip(*self.stem_tree.search([s for _, s in cut], [0 if len(s) < 5 else 1 if len(s) < 9 else 2 for _, s in cut]), strict=True):
            found[cut[q][0]] += [(w, d + 0.5, STEM) for w in self.by_stem[self.stem_tree.words[n]]]
        for i, (token, word) in enumerate(zip(asked, bare, strict=True)):
            if token[-1] == "." and len(word) >= 2 or len(word) >= 4:
                found[i] += [(w, 0.75, SHORT if token[-1] == "." else BARE) for w in self.prefixes.get(word, ())]
        return found


def entry_words(name: str) -> list[str]:
    """The distinct content words of an entry."""
    return list(dict.fromkeys(t.rstrip(".") for t in tokens(name)))


def is_common(entries_with: int, entries: int) -> bool:
    """Whether a word is in so many entries of the list that it tells nothing about which is meant."""
    return entries_with > max(5, entries / 4)


class Reference:
    """A whole reference list in memory: entries and words, and what has been found for words and texts so far."""

    def __init__(self, entries: Iterable[tuple[int, str]]):
        names = [(i, entry_words(name)) for i, name in entries]
        names = [(i, ws) for i, ws in names if ws]
        often = Counter(w for _, ws in names for w in ws)
        common = {w for w, n in often.items() if is_common(n, len(names))}
        self.entries = {i: [w for w in ws if w not in common] or ws for i, ws in names}
        self.by_word: dict[str, list[int]] = defaultdict(list)
        for i, ws in self.entries.items():
            for w in ws:
                self.by_word[w].append(i)
        self.words = Words(self.by_word)
        self.cache: dict[str, dict[str, float]] = {}
        self.forms: dict[str, tuple[int, float, int]] = {}

    def learn(self, words: Iterable[str]) -> None:
        """Find the reference words near each of the words that are not known yet."""
        new = list(dict.fromkeys(w for w in words if w not in self.cache))
        if len(self.cache) + len(new) > _CACHE:
            self.cache.clear()
        self.cache.update(zip(new, map(settle, self.words.hits(new)), strict=True))

    def best(self, words: Sequence[str]) -> tuple[int, float, int]:
        """(matched words, cost, id) of the entry that keeps at least two of its content words, else (0, 0.0, -1)."""
        got: dict[int, dict[str, tuple[float, int]]] = defaultdict(dict)
        for at, t in enumerate(words):
            for w, cost in self.cache.get(t, {}).items():
                for entry in self.by_word[w]:
                    if w not in got[entry] or (cost, at) < got[entry][w]:
                        got[entry][w] = (cost, at)
        best = (0, 0.0, -1)
        for entry, hits in got.items():
            n = min(len(hits), len({at for _, at in hits.values()}))
            if n >= min(2, len(self.entries[entry])):
                cost = sum(sorted(c for c, _ in hits.values())[:n])
                if cost <= most(n) and (best[2] == -1 or (-n, cost, entry) < (-best[0], best[1], best[2])):
                    best = (n, cost, entry)
        return best


def most(n: int) -> float:
    """The cost up to which ``n`` matched words speak for an entry: two that are both far off do not."""
    return 2.5 if n == 2 else 2.0 * n


def _match(batches, entries):
    reference = Reference(entries.value)
    for b in batches:
        texts = b.column(1).dictionary_encode()
        forms = texts.dictionary.to_pylist()
        split = {f: tokens(f) for f in forms if f is not None and f not in reference.forms}
        if len(reference.forms) + len(split) > _CACHE:
            reference.forms.clear()
            split = {f: tokens(f) for f in forms if f is not None}
        reference.learn(t for ts in split.values() for t in ts)
        for f, ts in split.items():
            reference.forms[f] = reference.best(ts)
        hits = [reference.forms.get(f, (0, 0.0, -1)) for f in forms]
        taken = texts.indices.to_pylist()
        rows = [(0, 0.0, -1) if i is None else hits[i] for i in taken]
        matched, cost, entry = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(matched, pa.int32()), pa.array(cost, pa.float64()), pa.array(entry, pa.int64())], names=["row_key", "matched", "cost", "entry_id"]
        )


def _split(batches, f, names):
    """Each text (the last column) with its words in order."""
    for b in batches:
        words = [f(t) for t in b.column(b.num_columns - 1).to_pylist()]
        at = pa.array(np.repeat(np.arange(len(words)), list(map(len, words))))
        place = pa.array([i for ws in words for i in range(len(ws))], pa.int32())
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), place, pa.array([w for ws in words for w in ws], pa.string())], names=names)


def _sharded(rows: DataFrame, names: DataFrame, shard: int) -> DataFrame:
    """The same as :func:`_match` for a list of any length: its words are searched shard by shard, the hits of all shards
    are merged for each word of the texts, and only then entries are chosen, by joins on words."""
    spark = rows.sparkSession
    held = names.mapInArrow(lambda bs: _split(bs, entry_words, ["entry", "at", "word"]), "entry long, at int, word string").select("entry", "word").distinct()
    held = materialize(held, "entry_words")
    n_entries = held.select("entry").distinct().count()
    often = held.groupBy("word").agg(F.count("*").alias("n"))
    # words in more than a quarter of the entries: there are few
    common = often.where(F.col("n") > F.greatest(F.lit(5), F.lit(n_entries / 4))).select("word", F.lit(True).alias("common"))
    kept = held.join(common, "word", "left").groupBy("entry").agg(F.collect_list("word").alias("every"), F.collect_list(F.when(F.col("common").isNull(), F.col("word"))).alias("rare"))
    kept = kept.select("entry", F.when(F.size("rare") > 0, F.col("rare")).otherwise(F.col("every")).alias("ws"))
    entries = materialize(kept.select("entry", F.size("ws").alias("size"), F.explode("ws").alias("word")), "entries")
    words = materialize(entries.select("word").distinct(), "words")
    shards = max(1, -(-words.count() // shard))

    texts = materialize(rows.where(F.col("text").isNotNull()).select("text").distinct(), "texts")
    split = texts.select("text", F.col("text").alias("t")).mapInArrow(lambda bs: _split(bs, tokens, ["text", "at", "token"]), "text string, at int, token string")
    split = materialize(split, "tokens")
    asked = materialize(spread(split.select("token").distinct(), "token"), "asked")
    found = []
    for k in range(shards):
        part = words.where(F.pmod(F.xxhash64("word"), F.lit(shards)) == k)
        shared = spark.sparkContext.broadcast([r[0] for r in part.collect()])

        def search(batches, shared=shared):
            tree = Words(shared.value)
            for b in batches:
                asked = b.column(0).to_pylist()
                rows = [(t, *h) for t, hs in zip(asked, tree.hits(asked), strict=True) for h in hs]
                cols = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.float64(), pa.int32()), strict=True)], names=["token", "word", "cost", "kind"])

        found.append(asked.mapInArrow(search, "token string, word string, cost double, kind int"))

    def merge(batches):
        for b in batches:
            rows = [(t, w, c) for t, hs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for w, c in settle((h["word"], h["cost"], h["kind"]) for h in hs).items()]
            cols = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.float64()), strict=True)], names=["token", "word", "cost"])

    hits = reduce(DataFrame.unionByName, found).groupBy("token").agg(F.collect_list(F.struct("word", "cost", "kind")).alias("hits"))
    hits = materialize(hits.mapInArrow(merge, "token string, word string, cost double"), "hits")
    met = split.join(hits, "token").join(entries, "word").groupBy("text", "entry", "size", "word").agg(F.min(F.struct("cost", "at")).alias("m"))
    met = met.groupBy("text", "entry", "size").agg(F.count("*").alias("words"), F.countDistinct("m.at").alias("places"), F.array_sort(F.collect_list("m.cost")).alias("costs"))
    n = F.least("words", "places").cast("int")
    met = met.withColumn("matched", n).withColumn("cost", F.aggregate(F.slice("costs", F.lit(1), n), F.lit(0.0), lambda x, y: x + y))
    limit = F.when(F.col("matched") == 2, most(2)).otherwise(F.col("matched") * most(1))
    met = met.where((F.col("matched") >= F.least(F.lit(2), F.col("size"))) & (F.col("cost") <= limit))
    winner = met.groupBy("text").agg(F.max(F.struct("matched", (-F.col("cost")).alias("c"), (-F.col("entry")).alias("e"))).alias("w"))
    out = rows.join(winner, "text", "left")
    return out.select("row_key", F.coalesce("w.matched", F.lit(0)).alias("matched"), F.coalesce(-F.col("w.c"), F.lit(0.0)).alias("cost"), F.coalesce(-F.col("w.e"), F.lit(-1)).alias("entry_id"))


def map_to_reference(df: DataFrame, key: str, text: str, reference: DataFrame, entry_id: str, entry_name: str, shard: int = SHARD) -> DataFrame:
    """``row_key, matched, cost, entry_id`` for each row of ``df``: the entry its text stands for, or -1.

    A text stands for an entry if it keeps at least two of its content words (all, if it has fewer), each within an
    edit distance that grows with its length, inflected, or abbreviated, in any order. Content words are looked up in a
    BK-tree of the reference list's words: the triangle inequality leaves out subtrees, and every word within the
    threshold comes out. Words and forms met before are remembered in each task.

    The list goes to the tasks whole if it has at most ``shard`` entries. Else its words are searched in shards of about
    that many, the hits of all shards are merged for each word of the texts, and entries are chosen from the merged hits
    by joins: the result is the same at every size of a shard, and what is broadcast has a bound. Of several entries the
    one with more matched words, then the lower cost, then the smaller id wins.

    Defined cases: a null or blank text, or one without content words, stands for no entry; null and blank names are no
    entries; an empty list gives -1 everywhere; repeated rows each get their row.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("row_key"), F.col(text).alias("text"))
    names = reference.select(F.col(entry_id).cast("long").alias("id"), F.col(entry_name).alias("name")).where(F.col("name").isNotNull())
    if names.count() > shard:
        return _sharded(rows, names, shard)
    entries = spark.sparkContext.broadcast([tuple(r) for r in names.collect()])
    return rows.mapInArrow(lambda batches: _match(batches, entries), "row_key long, matched int, cost double, entry_id long")


def free_values(df: DataFrame, key: str, text: str, reference: DataFrame, entry_name: str) -> DataFrame:
    """Distinct (key, text) whose text is neither null nor blank nor exactly an entry; dealt evenly over the tasks.

    The exact entries, often most rows, fall away before the shuffle. A key with several texts keeps each of them.
    """
    names = reference.select(F.col(entry_name).alias(text)).distinct()
    kept = df.select(key, text).where(F.col(text).rlike(r"(?U)\S")).join(names, text, "left_anti")
    return spread(kept, key).dropDuplicates([key, text])
