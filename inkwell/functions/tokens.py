"""Tokenizers: plain words, words with accents folded, Porter stems, trigrams; and grapheme runs of unspaced scripts."""

from __future__ import annotations

import re
import shlex
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.errors import InkwellError

TOKENIZERS = ("porter", "unicode61", "ascii", "trigram")
_VOWELS = set("aeiou")


def _consonant(word: str, i: int) -> bool:
    c = word[i]
    if c in _VOWELS:
        return False
    return c != "y" or i == 0 or not _consonant(word, i - 1)


def _measure(stem: str) -> int:
    """Vowel runs that a consonant run follows."""
    kinds = "".join("c" if _consonant(stem, i) else "v" for i in range(len(stem)))
    return len(re.findall("v+c+", kinds))


def _vowel(stem: str) -> bool:
    return any(not _consonant(stem, i) for i in range(len(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _consonant(word, len(word) - 1)


def _cvc(word: str) -> bool:
    n = len(word)
    return n > 2 and _consonant(word, n - 1) and not _consonant(word, n - 2) and _consonant(word, n - 3) and word[-1] not in "wxy"


#: Suffixes of Porter's steps 2, 3 and 4 (1980). Fixed values.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def porter(word: str) -> str:
    """Porter's stem of a lower-case word."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if s := _longest(word, ("sses", "ies", "ss", "s")):
        word = word[: -len(s)] + {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}[s]
    s = _longest(word, ("eed", "ed", "ing"))
    if s == "eed":
        if _measure(word[:-3]):
            word = word[:-1]
    elif s and _vowel(word[: -len(s)]):
        word = word[: -len(s)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _double(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _cvc(word):
            word += "e"
    if word.endswith("y") and _vowel(word[:-1]):
        word = word[:-1] + "i"
    for table in (_STEP2, _STEP3):
        if (s := _longest(word, table)) and _measure(word[: -len(s)]):
            word = word[: -len(s)] + table[s]
    if s := _longest(word, _STEP4):
        stem = word[: -len(s)]
        if _measure(stem) > 1 and (s != "ion" or stem.endswith(("s", "t"))):
            word = stem
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _cvc(word[:-1]):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def fold(text: str) -> str:
    """Lower case, accents of Latin letters off."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


#: Words whose tokens a worker remembers, and the longest of them. Beyond that all are forgotten; the tokens are the same.
REMEMBERED, LONG = 1 << 18, 64


class _Memory(dict):
    """What is made of each word, once in a process."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str):
        token = self.make(word)
        if len(word) <= LONG:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = token
        return token


#: By whether words are folded and stemmed.
_MEMORIES = {
    (False, False): _Memory(str.lower),
    (True, False): _Memory(fold),
    (False, True): _Memory(lambda w: porter(w.lower())),
    (True, True): _Memory(lambda w: porter(fold(w))),
}


@lru_cache(maxsize=64)
def _first(begins: tuple[str, ...], folds: bool) -> _Memory:
    """Whether a word with this first letter can begin so."""
    plain = fold if folds else str.lower
    return _Memory(lambda c: not plain(c) or any(b[:1] in ("", plain(c)[0]) for b in begins))


class Tokenizer:
    """A tokenizer by its specification: ``[porter] unicode61|ascii [tokenchars '…'] [separators '…'] [remove_diacritics 0|1|2]`` or ``trigram``."""

    def __init__(self, spec: str = "porter unicode61"):
        try:
            parts = shlex.split(spec)
        except ValueError as e:
            raise InkwellError("CONFIG_INVALID", f"content.tokenize {spec!r}: {e}") from None
        self.spec, self.stem = spec, bool(parts) and parts[0] == "porter"
        parts = parts[1:] if self.stem else parts
        self.base = parts[0] if parts else "unicode61"
        if self.base not in TOKENIZERS[1:] or len(parts) % 2 == 0 and parts:
            raise InkwellError("CONFIG_INVALID", f"content.tokenize {spec!r} is not a known tokenizer; use one of {', '.join(TOKENIZERS)}")
        options = dict(zip(parts[1::2], parts[2::2], strict=True))
        if bad := set(options) - {"tokenchars", "separators", "remove_diacritics", "categories", "case_sensitive"}:
            raise InkwellError("CONFIG_INVALID", f"content.tokenize {spec!r} has unknown option(s) {', '.join(sorted(bad))}")
        extra = "".join(f"\\u{ord(c):04x}" for c in options.get("tokenchars", ""))
        self.folds = self.base != "ascii" and options.get("remove_diacritics", "1") != "0"
        cut = set(options.get("separators", ""))
        self.cut = str.maketrans({c: " " for c in cut})
        self.words = re.compile(r"[^\W_]+" if not extra else rf"(?:[^\W_]|[{extra}])+") if self.base != "ascii" else re.compile(rf"[A-Za-z0-9\x80-\U0010ffff{extra}]+")

    def tokens(self, text: str | None) -> list[str]:
        text = self._prepared(text)
        if self.base == "trigram":
            return [text[i : i + 3] for i in range(len(text) - 2)]
        return list(map(_MEMORIES[self.folds, self.stem].__getitem__, self.words.findall(text)))

    def _prepared(self, text: str | None) -> str:
        text = text or ""
        text = text.translate(self.cut) if self.cut else text
        return text.lower() if self.base == "trigram" else text

    def places(self, text: str | None, exact: frozenset[str], heads: tuple[str, ...] = ()) -> tuple[int, list[tuple[str, int]]]:
        """How many tokens a text has, and the tokens that are in ``exact`` or begin with one of ``heads``, with their positions.

        Trigrams are looked up in the text: an array of them weighs many times the text.
        """
        if self.base == "trigram":
            text = self._prepared(text)
            found = set()
            for t in {t for t in exact if len(t) == 3} | set(heads):
                at = text.find(t)
                while 0 <= at <= len(text) - 3:
                    found.add(at)
                    at = text.find(t, at + 1)
            return max(0, len(text) - 2), [(text[at : at + 3], at) for at in sorted(found)]
        words = self.words.findall(self._prepared(text))
        # A stem is the beginning of its word and at most two other letters (-bility: -ble), so few words need one.
        begins = tuple(sorted({t[:-2] if self.stem else t for t in (*exact, *heads)}))
        first, memory, out = _first(begins, self.folds), _MEMORIES[self.folds, self.stem], []
        for at, w in [(at, w) for at, w in enumerate(words) if first[w[0]]]:
            if not w.isascii() or w.lower().startswith(begins):
                token = memory[w]
                if token in exact or heads and token.startswith(heads):
                    out.append((token, at))
        return len(words), out

    @property
    def native(self) -> bool:
        """Whether ``column`` stays in the JVM."""
        return not self.stem and not self.folds and self.base == "unicode61" and self.words.pattern == r"[^\W_]+"

    def column(self, text: Column) -> Column:
        """An array of tokens. Plain words stay in the JVM; folding, stems and trigrams take a vectorised function."""
        if self.native:
            return words(text)
        own = self

        def cut(s: pd.Series) -> pd.Series:
            return s.map(own.tokens)

        return F.pandas_udf(cut, "array<string>")(text)


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)


#: Scripts written without blanks, as character ranges, with the marks that join their letters. Fixed values.
UNSPACED = "ก-ฺเ-๛ກ-ໟက-႟ក-៹⺀-⿟々-〇〡-〩〱-〵〸-〻ぁ-ゖ゙-ゟァ-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ\U00020000-\U0003134f"
_RUN = re.compile(f"[{UNSPACED}][{UNSPACED}̀-ͯ︀-️]*")
_EDGE = "ꞏ"  # a letter that no script here uses; stands at the ends of a run, so that phrases don't cross runs
_COLUMNS = ("title", "summary", "text")


def graphemes(run: str) -> list[str]:
    """Letters with the marks that belong to them."""
    out: list[str] = []
    for c in run:
        if out and unicodedata.category(c) in ("Mn", "Mc", "Me"):
            out[-1] += c
        else:
            out.append(c)
    return out


def segment_field(text: str | None) -> str:
    """Text with each unspaced run as its graphemes between marks; empty where there is no run."""
    if not text or not _RUN.search(text):
        return ""
    spaced = _RUN.sub(lambda m: f" {_EDGE} {' '.join(graphemes(m[0]))} {_EDGE} ", text)
    return " ".join(spaced.split())


_QUERY = re.compile(rf'"(?:[^"]|"")*"?|(?:(?:(-)\s*)?\b({"|".join(_COLUMNS)})\s*:\s*)?({_RUN.pattern})')


def segment_match(terms: str | None) -> str:
    """A query with each unspaced run outside quotes as a phrase of graphemes; a column before it becomes its sidecar."""

    def put(m: re.Match) -> str:
        if m[3] is None:
            return m[0]
        own = graphemes(m[3])
        phrase = own[0] if len(own) == 1 else f'"{" ".join(own)}"'
        return f"{m[1] or ''}{m[2]}_seg:{phrase}" if m[2] else phrase

    return _QUERY.sub(put, terms or "")


def segment_column(text: Column) -> Column:
    def segmented(s: pd.Series) -> pd.Series:
        return s.map(segment_field)

    return F.pandas_udf(segmented, "string")(text)
