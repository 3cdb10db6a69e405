"""Text decoded with the wrong character encoding: finding it and restoring it.

A noisy channel: the text as it is was written in one encoding and read in another, and some of its bytes or characters
may be lost. Every run of characters without a space becomes a lattice, whose edges read one or more of its characters
as they stand, as the bytes of another encoding, or as a wildcard for what is lost; a Viterbi search under the corpus'
letter trigrams and word frequencies finds the best way through it.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawloom.session import materialize, spread

#: Share of all words, and of all letter trigrams, from which one is held in memory: so there are at most 1 / RARE of each.
#: A rarer word is judged by its letters, a rarer trigram by its last letter.
RARE = (1e-6, 1e-7)
#: Log-odds of a run of characters from which a document is taken for wrongly decoded.
ODDS = 2.5
#: The same for letters of an encoding of one byte, where any letter can stand for another.
SINGLE_ODDS = 4.0
#: What it speaks for a reading that several characters are one byte sequence of UTF-8: ordinary text has few such.
SEQUENCE = 3.0
#: The same inside a run that holds such a reading beyond doubt.
SURE = 10.0
#: Encodings under which UTF-8 was read, written as UTF-8, and read again: pairs of these.
TWICE = ("cp1252", "latin_1", "cp1250")
#: Log-odds between two ways to one place from which the worse is given up: the most frequent word speaks for itself with 14.
BEHIND = 30.0
#: What an unseen character costs, as a share of all characters; and how often wrong encodings are undone one after another.
UNSEEN, ROUNDS = 1e-7, 6

#: Encodings for which UTF-8 has been mistaken. Python leaves some of their bytes open; those read as control characters.
MULTI = ("cp1252", "latin_1", "cp1250", "iso8859_2", "iso8859_16", "cp437", "cp850", "cp852", "mac_roman", "mac_latin2", "cp1251", "cp1254")
#: (encoding taken, right encoding) of texts in an encoding of one byte a letter.
SINGLE = (("cp1252", "iso8859_16"), ("cp1252", "iso8859_2"), ("cp1252", "cp1250"), ("iso8859_2", "cp1252"), ("cp1250", "cp1252"), ("cp1252", "cp1251"))
LOST = "\ufffd"
LOST_BYTES = LOST * 2
_COMMA = str.maketrans("şţŞŢ", "șțȘȚ")


def _bytes_of(codec: str) -> dict[str, int]:
    out = {}
    for b in range(0x80, 0x100):
        try:
            ch = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            ch = chr(b)
        out[ch] = b
    return out


_BYTES = {c: _bytes_of(c) for c in MULTI}
_BACK = {c: {b: ch for ch, b in t.items()} for c, t in _BYTES.items()}


def _read(text: str, codec: str) -> str:
    """A text as it looks after its UTF-8 bytes were decoded by ``codec``."""
    back = _BACK[codec]
    return "".join(ch if ch.isascii() else "".join(back[b] for b in ch.encode()) for ch in text)


def _class(chars: Iterable[str]) -> str:
    """A class of characters for a pattern, by ranges."""
    ranges: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(rf"\x{{{a:X}}}" if a == b else rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"


#: Bytes that begin a UTF-8 sequence of two, three and four bytes, and those that go on with one.
_LEADS = {2: range(0xC2, 0xE0), 3: range(0xE0, 0xF0), 4: range(0xF0, 0xF5)}
_GOING_ON = range(0x80, 0xC0)


def _sequences(codec: str) -> str:
    """The readings under ``codec`` of whole UTF-8 sequences, as a pattern of the JVM's."""
    back = _BACK[codec]
    on = _class(back[b] for b in _GOING_ON)
    return "|".join(_class(back[b] for b in leads) + f"{on}{{{n - 1}}}" for n, leads in _LEADS.items())


def _python(pattern: str) -> re.Pattern[str]:
    return re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern))


_SEQUENCE = {c: _python(_sequences(c)) for c in MULTI}
#: Two characters of which the first can begin and the second go on with a sequence, whatever the encodings: a quick look.
_QUICK = _class({_BACK[c][b] for c in MULTI for n in _LEADS for b in _LEADS[n]}) + _class({_BACK[c][b] for c in MULTI for b in _GOING_ON})
_SEQUENCES = f"(?={_QUICK})(?:{'|'.join(_sequences(c) for c in MULTI)})"
#: Runs without a space; a space is one of ASCII, as others can be bytes.
_RUN = re.compile(r"[^\x00-\x20\x7F]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_LOST_SIGN = re.compile(r"(?<=[^\W\d_])\?(?=[^\W\d_])")
_ONE_MARK = re.compile(rf"(?<!{LOST}){LOST}(?!{LOST})")
_DIGITS = str.maketrans("123456789", "000000000")


def _swaps(taken: str, right: str) -> dict[str, str]:
    """Letters of the right encoding by the characters that they were taken for."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            wrong, good = bytes([b]).decode(taken), bytes([b]).decode(right).translate(_COMMA)
        except UnicodeDecodeError:
            continue
        if wrong != good and good.isalpha():
            out[wrong] = good
    return out


@dataclass
class Corpus:
    """Word frequencies and letter trigrams of the corpus, over what stands in order and holds a letter beyond ASCII."""

    words: dict[str, int]
    trigrams: dict[str, int]
    n_words: int = 0

    def __post_init__(self) -> None:
        # counts of contexts of two, one and no characters before a character, and of the different ones that follow
        self.two, self.one, self.letters = self.trigrams, Counter(), Counter()
        self.context, self.follow = Counter(), Counter()
        for t, n in self.trigrams.items():
            self.one[t[1:]] += n
            self.letters[t[2]] += n
            self.context[t[:2]] += n
            self.follow[t[:2]] += 1
        for t, n in self.one.items():
            self.context[t[0]] += n
            self.follow[t[0]] += 1
        self.n_letters = max(1, sum(self.letters.values()))
        self.n_words = self.n_words or max(1, sum(self.words.values()))
        self.lexicon = sorted(self.words)
        #: What a lost character can have been, by the number of its bytes.
        self.alphabet: dict[int, list[str]] = defaultdict(list)
        for ch, n in sorted(self.letters.items()):
            if not ch.isascii() and ch.isprintable() and n >= 1e-6 * self.n_letters:
                self.alphabet[len(ch.encode())].append(ch)
        #: Swaps that lead from a rarer letter to a more frequent one.
        self.swaps: dict[tuple[str, str], dict[str, str]] = {}
        for pair in SINGLE:
            table = {w: g for w, g in _swaps(*pair).items() if self.share(g) > max(self.share(w), 10 * UNSEEN)}
            if table and table not in self.swaps.values():
                self.swaps[pair] = table
        self.swap_signs = "".join(sorted({w for t in self.swaps.values() for w in t}))
        self.swap_pattern = {p: re.compile(f"[{re.escape(''.join(t))}]") for p, t in self.swaps.items()}
        self.odd = re.compile(f"[{re.escape(self.swap_signs)}]") if self.swap_signs else None
        self.cache: dict[tuple, tuple[str, float]] = {}
        self.plain: dict[str, float] = {}
        self.wild: dict[tuple[str, int], list[str]] = {}
        self.readings: dict[str, list[tuple[object, str, float, bool]]] = {}
        self.small: dict[str, str] = {}
        self.steps: dict[str, float] = {}

    def share(self, ch: str) -> float:
        low = ch.lower()
        return max((self.letters.get(c, 0) for c in low), default=0) / self.n_letters + UNSEEN

    def step(self, context: str, ch: str) -> float:
        """Log-probability of a character after two others: what is unknown after two is looked up after one, and then by
        how frequent it is; the more different characters followed, the more a new one is to be expected."""
        t = context + ch
        s = self.steps.get(t)
        if s is None:
            p = self.share(ch)
            for c, counts in ((context[1], self.one), (context, self.two)):
                new = self.follow[c] + 1
                p = (counts.get(c + ch, 0) + new * p) / (self.context[c] + new)
            s = self.steps[t] = math.log(p)
        return s

    def following(self, before: str, size: int) -> list[str]:
        """Characters of so many bytes that a lost one after ``before`` can have been: those that ever followed it."""
        key = (before, size)
        if key not in self.wild:
            self.wild[key] = [u for u in self.alphabet[size] if before + u in self.one] or self.alphabet[size]
        return self.wild[key]

    def bonus(self, word: str) -> float:
        """What it speaks for a word of several letters that the corpus has it, by how often in a million words."""
        return 0.0 if len(word) < 2 else math.log1p(1e6 * self.words.get(word, 0) / self.n_words)


def _edges(run: str, channel: object, corpus: Corpus) -> list[list[tuple[int, str | int]]]:
    """The lattice of a run: at each place the readings that begin there, as (where they end, what they read).

    ``channel`` is an encoding that UTF-8 was mistaken for, a pair of encodings of one byte, or LOST or LOST_BYTES for
    lost characters, each with a mark of its own or with one for each of its bytes. A lost byte inside a sequence is a wildcard: it goes with every character of the
    corpus' alphabet whose other bytes are there. A wildcard for a whole character is given by its number of bytes.
    """
    n = len(run)
    edges: list[list[tuple[int, str]]] = [[(i + 1, run[i])] for i in range(n)]
    if channel in _BYTES:
        table = _BYTES[channel]
        data = [table.get(c, 0 if c != LOST else None) for c in run]
        for i, b in enumerate(data):
            if b is not None and b < 0xC2:
                continue
            for size, leads in _LEADS.items():
                part = data[i : i + size]
                if len(part) < size or not (b is None or b in leads) or not all(x is None or x in _GOING_ON for x in part[1:]):
                    if size == 2 and b is not None and b in leads and i + 1 == n:
                        # the last byte is gone with a space
                        edges[i] += [(i + 1, u) for u in corpus.alphabet[2] if u.encode()[0] == b]
                    continue
                if None in part:
                    if any(x is not None for x in part):
                        edges[i] += [(i + size, u) for u in corpus.alphabet[size] if all(x is None or x == y for x, y in zip(part, u.encode(), strict=True))]
                    continue
                try:
                    edges[i].append((i + size, bytes(part).decode()))
                except UnicodeDecodeError:
                    pass
    elif channel in (LOST, LOST_BYTES):
        for i, c in enumerate(run):
            if c == LOST:
                marks = next((k for k in range(i, n) if run[k] != LOST), n) - i
                for size, chars in corpus.alphabet.items():
                    k = size if channel == LOST_BYTES else 1
                    if k <= marks and chars:
                        edges[i].append((i + k, size))
            elif c == "?" and 0 < i < n - 1 and run[i - 1].isalpha() and run[i + 1].isalpha():
                edges[i] += [(i + 1, size) for size in corpus.alphabet]
    else:
        swap = corpus.swaps[channel]
        for i, c in enumerate(run):
            if c in swap:
                edges[i].append((i + 1, swap[c]))
    return edges


def _expanded(edges: list[tuple[int, str | int]], before: str, corpus: Corpus) -> Iterator[tuple[int, str]]:
    for j, u in edges:
        if isinstance(u, str):
            yield j, u
        else:
            for ch in corpus.following(before, u):
                yield j, ch


def _viterbi(edges: list[list[tuple[int, str | int]]], corpus: Corpus, sequence: float = SEQUENCE) -> tuple[str, float]:
    """The best way through a lattice: its text and log-probability.

    A state is a place, the last two characters, and the beginning of a word of the lexicon that the letters since the
    last sign are; one way a state is kept. Left out are ways that are further behind than ``BEHIND``, which no word makes
    up for.
    """
    lexicon, step, known_steps, small = corpus.lexicon, corpus.step, corpus.steps, corpus.small
    n, words = len(edges), len(lexicon)
    at: list[dict[tuple[str, str | None], tuple[float, str, int, int]]] = [{} for _ in range(n + 1)]
    at[0]["^^", ""] = (0.0, "", 0, words)
    for i in range(n):
        here, states = edges[i], at[i]
        least = max(v[0] for v in states.values()) - BEHIND if len(states) > 1 else -math.inf
        for (context, prefix), (score, out, lo, hi) in states.items():
            if score < least:
                continue
            for j, u in here if len(here) == 1 else _expanded(here, context[1], corpus):
                low = small.get(u) or small.setdefault(u, u.lower().translate(_DIGITS))
                c, s, p, a, b = context, score + (sequence if j > i + 1 else 0.0), prefix, lo, hi
                for ch in low:
                    t = c + ch
                    x = known_steps.get(t)
                    s += step(c, ch) if x is None else x
                    c = t[1:]
                    if not ch.isalpha():
                        if p:
                            s += corpus.bonus(p)
                        p, a, b = "", 0, words
                    elif p is not None:
                        p += ch
                        a = bisect_left(lexicon, p, a, b)
                        # the beginning of a word is kept only while a word of the lexicon begins so
                        if a == b or not lexicon[a].startswith(p):
                            p = None
                if u == LOST or u == "?" and len(here) > 1:
                    s -= 50.0  # only if nothing else is left
                known = at[j].get((c, p))
                if known is None or s > known[0]:
                    at[j][c, p] = (s, out + u, a, b)
        at[i] = {}
    best = ("", -math.inf)
    for (context, prefix), (score, out, *_) in at[n].items():
        score += step(context, "$") + (corpus.bonus(prefix) if prefix else 0.0)
        if score > best[1]:
            best = (out, score)
    return best


def _plain(run: str, corpus: Corpus) -> float:
    """The log-probability of a run as it stands."""
    if run not in corpus.plain:
        if len(corpus.plain) > 1 << 17:
            corpus.plain.clear()
        padded = "^^" + run.lower().translate(_DIGITS) + "$"
        steps, s = corpus.steps, 0.0
        for i in range(len(padded) - 2):
            x = steps.get(padded[i : i + 3])
            s += corpus.step(padded[i : i + 2], padded[i + 2]) if x is None else x
        corpus.plain[run] = s + sum(map(corpus.bonus, _LETTERS.findall(padded[2:-1]))) - 50.0 * run.count(LOST)
    return corpus.plain[run]


def _reread(sequence: str, codec: str) -> str:
    table = _BYTES[codec]
    return bytes(table[c] for c in sequence).decode(errors="replace")


def _decode(run: str, channel: object, corpus: Corpus) -> tuple[str, float]:
    """A run as read through a channel, and the log-odds of this reading against the run as it stands."""
    found = corpus.cache.get((run, channel))
    if found is None:
        if len(corpus.cache) > 1 << 18:
            corpus.cache.clear()
        found = corpus.cache[run, channel] = _best(run, channel, corpus)
    return found


def _best(run: str, channel: object, corpus: Corpus) -> tuple[str, float]:
    once = run
    if channel in _PAIRS:
        first, channel = channel[1:]
        once = _SEQUENCE[first].sub(lambda m: _reread(m.group(), first), run)
    if channel in _BYTES and LOST not in once and once.isascii():
        return run, 0.0
    edges = _edges(once, channel, corpus)
    if all(len(e) == 1 for e in edges):
        return run, 0.0
    # encodings often agree on what a run can be
    key = (run, once, tuple((i, *e[1:]) for i, e in enumerate(edges) if len(e) > 1))
    if key not in corpus.cache:
        text, score = _viterbi(edges, corpus)
        odds = score - _plain(run, corpus)
        if channel in _BYTES and odds > ODDS and _SEQUENCE[channel].search(text):
            text = _viterbi(edges, corpus, SURE)[0]
        corpus.cache[key] = (text, odds)
    return corpus.cache[key]


def _readings(run: str, corpus: Corpus) -> list[tuple[object, str, float, bool]]:
    """The channels through which a run reads better than as it stands: with what it reads then, the log-odds, and
    whether the run holds a whole sequence or letter of the encoding (else it only goes along with others)."""
    known = corpus.readings.get(run)
    if known is None:
        known = []
        for channel in (*MULTI, *_PAIRS, *corpus.swaps):
            pattern = corpus.swap_pattern[channel] if channel in corpus.swaps else _SEQUENCE[channel[1] if channel in _PAIRS else channel]
            whole = pattern.search(run) is not None
            if whole or channel in _BYTES and (LOST in run or _BYTES[channel].get(run[-1], 0) in _LEADS[2]):
                other, gain = _decode(run, channel, corpus)
                if other != run and gain > 0:
                    known.append((channel, other, gain, whole))
        if len(corpus.readings) > 1 << 18:
            corpus.readings.clear()
        corpus.readings[run] = known
    return known


def _undo(text: str, corpus: Corpus) -> tuple[str, bool]:
    """Undo the wrong encoding that speaks most for itself over all runs of the text, again and again while there is one."""
    undone = False
    for _ in range(ROUNDS):
        odds, most = Counter(), Counter()
        fixes: dict[object, dict[str, str]] = defaultdict(dict)
        for run, n in Counter(r for r in _RUN.findall(text) if not r.isascii()).items():
            for channel, other, gain, whole in corpus.readings.get(run) or _readings(run, corpus):
                fixes[channel][run] = other
                if whole:
                    odds[channel] += n * gain
                    most[channel] = max(most[channel], gain)
        sure = [c for c in odds if most[c] > (SINGLE_ODDS if c in corpus.swaps else ODDS)]
        if not sure:
            break
        undone = True
        fix = fixes[max(sure, key=odds.__getitem__)]
        text = _RUN.sub(lambda m, f=fix: f.get(m.group(), m.group()), text)
    return text, undone


def _fill(text: str, corpus: Corpus) -> str:
    """Fill in lost characters, each run by its own lattice.

    If a mark stands alone anywhere, the text has a mark for each character, else one for each byte. A lost character
    between spaces stays, as nothing tells what it was, unless the marks tell how many bytes it had.
    """
    way = LOST if LOST not in text or _ONE_MARK.search(text) else LOST_BYTES

    def fix(m: re.Match[str]) -> str:
        run = m.group()
        if way == LOST and not any(map(str.isalpha, run)) or LOST not in run and not _LOST_SIGN.search(run):
            return run
        filled = _decode(run, way, corpus)[0]
        # capitals are as the rest of the run has them
        return filled.upper() if run.isupper() and sum(map(str.isalpha, run)) > 1 else filled

    return _RUN.sub(fix, text)


def _is_suspicious(text: str, corpus: Corpus) -> bool:
    """The same as :func:`suspicious`, for one text."""
    if "?" in text and _LOST_SIGN.search(text):
        return True
    if text.isascii():
        return False
    if LOST in text or corpus.odd is not None and corpus.odd.search(text):
        return True
    beyond = _ASCII.sub(" ", text)
    return _QUICK_PY.search(beyond) is not None and any(p.search(beyond) for p in _SEQUENCE.values())


_ASCII, _QUICK_PY = re.compile(r"[\x00-\x7F]+"), _python(_QUICK)
_PAIRS = [("utf-8", a, b) for a in TWICE for b in TWICE]


def suspicious(text: Column, corpus: Corpus) -> Column:
    """Whether a text needs a closer look; null for null.

    It does if it holds the reading of a whole UTF-8 sequence under one of the encodings, a letter that takes the place
    of a more frequent one in an encoding of one byte, or a lost character. Runs of ASCII are cut to spaces first, which
    leaves little to look at.
    """
    odd = F.regexp_replace(text, r"[\x00-\x7F]+", " ").rlike(f"{_class({LOST, *corpus.swap_signs})}|{_SEQUENCES}")
    return odd | (F.contains(text, F.lit("?")) & text.rlike(r"\p{L}\?\p{L}"))


def restore(text: str | None, corpus: Corpus) -> tuple[str | None, bool]:
    """The restored text, and whether any of it had been decoded wrongly.

    Wrong encodings are undone where letters and words of the corpus speak for it, one after another; then lost
    characters are filled in. What nothing speaks for stays as it is. None and the empty text are in order.
    """
    if not text or not _is_suspicious(text, corpus):
        return text, False
    fixed, garbled = _undo(text, corpus)
    if LOST in fixed or _LOST_SIGN.search(fixed):
        garbled = True
        fixed = _fill(fixed, corpus)
    return (unicodedata.normalize("NFC", fixed) if garbled else text), garbled


def corpus_model(docs: DataFrame, text: str, extra: DataFrame | None = None) -> Corpus:
    """Frequencies over all texts, counted with partial aggregation; two tables of bounded size come to the driver.

    Counted are runs of characters that hold one beyond ASCII and no reading of a UTF-8 sequence: garbled ones would
    speak for themselves. Words and trigrams come out that make at least the shares ``RARE`` of all. ``extra`` are more
    words (column ``w``).
    """
    found = F.regexp_extract_all(F.col(text), F.lit(r"(?<![!-~])([!-~]*+[^\x00-\x7F][^\x00-\x20\x7F]*+)"), F.lit(1))
    runs = docs.select(F.explode(found).alias("r")).groupBy(F.translate("r", "123456789", "000000000").alias("r")).agg(F.count("*").alias("n"))
    sound = ~F.regexp_replace("r", r"[\x00-\x7F]+", " ").rlike(f"{LOST}|{_SEQUENCES}")
    runs = materialize(runs.where(sound).select(F.lower("r").alias("r"), "n"), "runs")
    words = runs.select("n", F.explode(F.regexp_extract_all("r", F.lit(r"(\p{L}+)"), F.lit(1))).alias("w")).where(~F.col("w").rlike(r"^[\x00-\x7F]*$"))
    if extra is not None:
        words = words.unionByName(extra.select(F.lit(1).cast("long").alias("n"), F.lower("w").alias("w")))
    words = words.groupBy("w").agg(F.sum("n").alias("n"))
    padded = F.concat(F.lit("^^"), "r", F.lit("$"))
    grams = runs.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("r") + 1), lambda i: F.substring(padded, i, F.lit(3)))).alias("g"))
    grams = grams.groupBy("g").agg(F.sum("n").alias("n"))
    counts = []
    for t, rare in zip((words, grams), RARE, strict=True):
        t = materialize(t, "counts")
        total = t.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        kept = t.where(F.col("n") >= rare * total).toArrow()
        counts.append((dict(zip(kept.column(0).to_pylist(), kept.column(1).to_pylist(), strict=True)), total))
    return Corpus(counts[0][0], counts[1][0], counts[0][1])


def restore_documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, restored`` of every document of which something was decoded wrongly.

    Two passes: frequencies over all documents, then the suspicious documents, which the JVM picks out, through Python
    in Arrow batches. ``restored`` is the whole text; what can't be restored stays. Nothing but the frequencies is
    shuffled, and the suspicious documents, to spread them.

    Defined cases: null and empty texts are in order; a repeated document comes out as often as it is there; other
    columns are ignored.
    """
    corpus = corpus_model(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(corpus)

    def run(batches):
        for b in batches:
            keys, out = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fixed, garbled = restore(t, shared.value)
                if garbled:
                    keys.append(k)
                    out.append(fixed)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.string())], names=["key", "restored"])

    picked = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where(suspicious(F.col("text"), corpus))
    return spread(picked).mapInArrow(run, "key long, restored string")
