"""Characters that look like ordinary writing without being it: detection, one consistent form, folding."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters of other scripts that look like Latin ones (from the public Unicode confusables data).
CYRILLIC = dict(zip("аеорсухіјѕһԁԛԝӏпгкАВЕКМНОРСТУХІЈЅԚԜӀ", "aeopcyxijshdqwlnrkABEKMHOPCTYXIJSQWI", strict=True))
GREEK = dict(zip("οναιρυκτχγμϲΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ", "ovaipuktxyucABEZHIKMNOPTYXC", strict=True))
ARMENIAN = dict(zip("օսհոցԼՏՕ", "ouhngLSO", strict=True))
# Latin letters that are drawn like other Latin letters.
LATIN = dict(zip("ıɑɡɩʟᴀᴄᴇᴏᴘᴛꞮƖ", "iagilaceoptIl", strict=True))
# Letters with cedilla that stand for those with comma below, and signs that are ordinary.
CEDILLA = dict(zip("şţŞŢ", "șțȘȚ", strict=True))
ORDINARY_SIGNS = "„”–§²"
# Signs that look like ASCII ones.
SIGNS = dict(zip("‐‑‒—―−﹣‘’‚‛′“‟«»″⁄∕∶․‥…", ["-"] * 7 + ["'"] * 5 + ['"'] * 5 + ["/", "/", ":", ".", "..", "..."], strict=True))

LOOKALIKE = CYRILLIC | GREEK | ARMENIAN | LATIN
#: Look-alikes of both I and l, which the rest of the word decides.
STROKES = frozenset("ӏӀ")
#: Scripts of the published table whose words are not ordinary writing in these texts, so a whole word can be one in disguise.
DISGUISE = ("CHEROKEE", "LISU", "COPTIC")
#: Letters that other scripts lend a mixed word only to look Latin; not used to call a whole word confusable.
WEAK = set("пгкγμκιυχτρα")
TO_SCRIPT = {"Cyrillic": {v: k for k, v in reversed(CYRILLIC.items())}, "Greek": {v: k for k, v in reversed(GREEK.items())}}

_SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian", "Hebrew", "Arabic", "Han", "Hiragana", "Katakana", "Hangul", "Bopomofo", "Devanagari", "Thai", "Georgian", "Bengali", "Tamil", "Ethiopic")
_SCRIPT_RE = [(s, regex.compile(rf"\p{{Script={s}}}")) for s in _SCRIPTS]
_COMMON = regex.compile(r"[\p{Script=Common}\p{Script=Inherited}]")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}\p{Cf}]+")
#: Scripts that are written together count as one.
_RESOLVED = {"Han": {"Hani", "Jpan", "Kore", "Hanb"}, "Hiragana": {"Jpan"}, "Katakana": {"Jpan"}, "Hangul": {"Kore"}, "Bopomofo": {"Hanb"}}

#: Rows without a match are ordinary throughout; everything else is looked at by the detector.
PREFILTER = r"[^\x00-\x7F„”–§²ăâîșțĂÂÎȘȚÀÁÄÇÈÉÊËÍÏÓÔÖÙÚÛÜàáäçèéêëíïóôöùúûü]"


@lru_cache(maxsize=1 << 16)
def scripts(ch: str) -> frozenset[str] | None:
    """The resolved script set of a character; None stands for all scripts (common and inherited ones)."""
    if ch.isascii():
        return frozenset(["Latin"]) if ch.isalpha() else None
    if _COMMON.match(ch):
        return None
    for name, pattern in _SCRIPT_RE:
        if pattern.match(ch):
            return frozenset(_RESOLVED.get(name, {name}))
    return frozenset([unicodedata.name(ch, "other").split()[0]])


@lru_cache(maxsize=1 << 16)
def _unordinary(ch: str) -> bool:
    """Whether a character is out of place wherever it stands."""
    if ch.isascii() or ch in ORDINARY_SIGNS:
        return False
    kind = unicodedata.category(ch)
    if kind in ("Cf", "Zs", "Zl", "Zp", "Cc"):
        return True
    if ch in CEDILLA or ch in LATIN or ch in SIGNS or _small_capital(ch):
        return True
    if unicodedata.normalize("NFKC", ch) != ch:
        return True
    if kind in ("Pd", "Pi", "Pf", "Sk"):
        return True
    return unicodedata.combining(ch) > 0 and _COMMON.match(ch) is not None


def token_scripts(token: str) -> frozenset[str] | None:
    """The scripts a token can be written in: the intersection over its characters. Empty: mixed; None: any."""
    found: frozenset[str] | None = None
    for ch in token:
        s = scripts(ch)
        if s is not None:
            found = s if found is None else found & s
            if not found:
                return found
    return found


class Table:
    """Look-alikes of ASCII letters: the fixed ones, and those of a published table if there is one."""

    def __init__(self, published: dict[str, str] | None = None):
        self.published = published or {}
        self.letters = self.published | LOOKALIKE
        self.whole = {c for c in LOOKALIKE if c not in WEAK} | {c for c in self.published if unicodedata.name(c, "").startswith(DISGUISE)}
        self.plain = _Plain(self.letters)

    def confusable(self, token: str) -> bool:
        letters = [c for c in token if c.isalpha()]
        return bool(letters) and all(c in self.whole for c in letters)


def published(spark: SparkSession) -> dict[str, str]:
    """Letters of other scripts and the ASCII letters that they look like, by the public confusables data.

    The data come with the Unicode library of the JVM, which turns texts into skeletons that are equal if they look
    alike; so a table is not kept here. A JVM without such a library, or with one that knows no letters of a script of
    DISGUISE, is an error, as the fixed letters alone find less. An ASCII letter that looks like another (I and l) stands
    for the one of the letter's case.
    """
    ascii_letters = [chr(c) for c in range(0x41, 0x7B) if chr(c).isalpha()]
    other = [c for c in map(chr, (*range(0x0250, 0x3000), *range(0xA000, 0xAC00), *range(0x10000, 0x20000))) if c.isalpha() and _foreign(c)]
    try:
        checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        skeletons = checker.getSkeleton("\n".join([*ascii_letters, *other])).split("\n")
    except Exception as e:
        raise RuntimeError("the published look-alikes can't be read from com.ibm.icu.text.SpoofChecker in the JVM") from e
    if len(skeletons) != len(ascii_letters) + len(other):
        raise RuntimeError(f"the published look-alikes have {len(skeletons)} skeletons of {len(ascii_letters) + len(other)} letters")
    stands: dict[str, list[str]] = {}
    for c, s in zip(ascii_letters, skeletons, strict=False):
        stands.setdefault(s, []).append(c)
    out = {}
    for c, s in zip(other, skeletons[len(ascii_letters) :], strict=True):
        if s in stands:
            out[c] = next((a for a in stands[s] if a.isupper() == c.isupper()), stands[s][0])
    known = {unicodedata.name(c).split()[0] for c in out}
    if missing := [s for s in DISGUISE if s not in known]:
        raise RuntimeError(f"the published look-alikes have none of {', '.join(missing)}")
    return out


@lru_cache(maxsize=1 << 16)
def _foreign(ch: str) -> bool:
    name = unicodedata.name(ch, "LATIN")
    return not name.startswith(("LATIN", "MODIFIER", "MATHEMATICAL", "CJK", "HANGUL", "YI ")) and unicodedata.normalize("NFKC", ch) == ch


def _small_capital(ch: str) -> str | None:
    """The letter of a small capital, by its name."""
    name = unicodedata.name(ch, "")
    letter = name.removeprefix("LATIN LETTER SMALL CAPITAL ")
    return letter.lower() if letter != name and len(letter) == 1 else None


def _whole(words: list[str], sets: list[frozenset[str] | None], table: Table) -> list[bool]:
    """For each word: whether it is wholly of look-alikes of another script, in a text without clear words of it."""
    clear = {next(iter(s)) for w, s in zip(words, sets, strict=True) if s and len(s) == 1 and "Latin" not in s and not table.confusable(w)}
    latin = any(s and "Latin" in s for s in sets)
    return [bool(s) and "Latin" not in s and table.confusable(w) and latin and not (s & clear) for w, s in zip(words, sets, strict=True)]


def suspicious(text: str | None, table: Table | None = None) -> bool:
    """Whether the text holds a character or sequence that looks like, or hides in, ordinary writing.

    None and the empty text hold none.
    """
    if not text or text.isascii():
        return False
    if any(map(_unordinary, text)) or unicodedata.normalize("NFC", text) != text:
        return True
    words = _WORD.findall(text)
    sets = [token_scripts(w) for w in words]
    return any(s is not None and not s for s in sets) or any(_whole(words, sets, table or BASE))


class _Plain(dict):
    """Per character: signs, spaces, hidden characters, compatibility and cedilla forms; letters keep their script, and
    look-alikes themselves, as their compatibility form can be a letter that looks different."""

    def __init__(self, letters: dict[str, str]):
        super().__init__()
        self.letters = letters

    def __missing__(self, cp: int) -> str:
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if ch.isascii() or ch in ORDINARY_SIGNS:
            out = ch
        elif kind == "Cf":
            out = ""
        elif kind == "Zs":
            out = " "
        elif kind in ("Zl", "Zp"):
            out = "\n"
        elif ch in SIGNS:
            out = SIGNS[ch]
        elif ch in LATIN:
            out = LATIN[ch]
        elif small := _small_capital(ch):
            out = small
        elif ch in self.letters:
            out = ch
        else:
            out = unicodedata.normalize("NFKC", ch)
        self[cp] = out
        return out


BASE = Table()


def normalize(text: str | None, table: Table | None = None) -> str | None:
    """The one consistent form of a text; None stays None.

    Hidden characters go, special spaces become spaces, compatibility forms, look-alike signs and cedillas the ordinary
    ones, accents are composed. A word of mixed scripts is spelled in the one script all its letters can be written in
    (Latin if that works, else the one most of them have); a word wholly of look-alikes in a text of Latin words becomes
    Latin. Words in another script stay. Applying it twice changes nothing more.
    """
    if not text or text.isascii():
        return text
    table = table or BASE
    text = unicodedata.normalize("NFC", text.translate(table.plain))
    for a, b in CEDILLA.items():
        text = text.replace(a, b)
    if text.isascii():
        return text
    spans = list(_WORD.finditer(text))
    words = [m.group() for m in spans]
    sets = [token_scripts(w) for w in words]
    if all(s is None or "Latin" in s for s in sets):
        return text
    out, at = [], 0
    for m, word, s, whole in zip(spans, words, sets, _whole(words, sets, table), strict=True):
        out.append(text[at : m.start()])
        out.append(_respell(word, table) if whole or s is not None and not s else word)
        at = m.end()
    out.append(text[at:])
    return unicodedata.normalize("NFC", "".join(out))


def _respell(word: str, table: Table) -> str:
    others = [c for c in word if c.isalpha() and c not in STROKES]
    small = bool(others) and not any(c.isupper() for c in others)
    letters = {c: ("l" if small else "I") if c in STROKES else table.letters.get(c, c) for c in set(word)}
    latin = "".join(map(letters.__getitem__, word))
    if (s := token_scripts(latin)) is None or s:
        return latin
    options = []
    for name, table in TO_SCRIPT.items():
        spelled = "".join(table.get(LOOKALIKE.get(c, c), c) if name not in (scripts(c) or {name}) else c for c in word)
        if token_scripts(spelled):
            options.append((sum(a == b for a, b in zip(word, spelled, strict=True)), spelled))
    return max(options)[1] if options else word


class _Fold(dict):
    """Per character: its lower-case ASCII skeleton, for comparing."""

    def __missing__(self, cp: int) -> str:
        ch = BASE.plain[cp]
        ch = "".join(LOOKALIKE.get(c, c) for c in ch)
        out = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c)).lower()
        self[cp] = out
        return out


_fold = _Fold()
_DIGITS = str.maketrans("0134578", "oleastb")
_MIXED = re.compile(r"[a-z]*\d[a-z]+\w*|[a-z]+\d\w*")


def fold(text: str) -> str:
    """The skeleton of a text: look-alikes, accents and case undone, digits inside words read as letters."""
    text = text.lower() if text.isascii() else text.translate(_fold)
    return _MIXED.sub(lambda m: m.group().translate(_DIGITS), text) if any(map(str.isdigit, text)) else text


def _apply(batches, f, kind):
    for b in batches:
        column = b.column(b.num_columns - 1).to_pylist()
        kept = [f(x) for x in column]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(kept, kind)], names=[*b.schema.names[:-1], "out"])


def _rows(df: DataFrame, key: Column, text: str) -> DataFrame:
    return df.select(key.alias("row_key"), F.col(text).alias("text")).where(F.col("text").rlike(PREFILTER))


def find_lookalikes(df: DataFrame, key: Column, text: str) -> DataFrame:
    """``row_key, normalized`` of every record whose text is not ordinary throughout, each distinct record once.

    Look-alikes are the fixed letters and those of the published data (see :func:`published`). The JVM passes over texts that hold only ordinary characters; only the rest reaches Python, in Arrow batches. There
    is no shuffle but for repeated records. Null and empty texts hold nothing; other columns are ignored.
    """

    shared = df.sparkSession.sparkContext.broadcast(published(df.sparkSession))

    def run(batches):
        table = Table(shared.value)
        for b in batches:
            keys, out = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if suspicious(t, table):
                    keys.append(k)
                    out.append(normalize(t, table))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(out, pa.string())], names=["row_key", "normalized"])

    return _rows(df, key, text).mapInArrow(run, "row_key string, normalized string").distinct()
