"""Personal data: format-preserving Feistel pseudonyms.

Finds e-mail addresses, payment card numbers, telephone numbers, IPv4 addresses, social security numbers and calendar
dates, and checks each: cards by length and Luhn's digit, addresses by octet, dates by the calendar, social security
numbers by their reserved ranges. A valid value is replaced by a keyed permutation of its own format: symbols are read
as a number of mixed radix (ten for a digit, twenty-six for a letter), which a Feistel network of ten rounds permutes;
separators, letter case, an address's domain, a telephone's country code stay. A card's check digit is made anew, a date
is walked to another valid date of the years 1900 to 2099, so a pseudonym passes the same checks. Equal values have
equal pseudonyms in every document whatever their separators, different values different ones, and ``restore`` with
the key gets them back.

Defined cases: null stays null with no findings; empty text stays empty; the leftmost and then the longest alternative
listed first wins where findings would overlap; repeated rows give repeated results; other columns pass through.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
KINDS = ("email", "card", "phone", "ipv4", "ssn", "date")

_FINDER = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![A-Za-z0-9]))"
    r"|(?P<ipv4>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d))"
    r"|(?P<card>(?<![\d])(?:\d{13,19}|\d{4}([ -])\d{4}\4\d{4}\4\d{1,7}|\d{4}([ -])\d{6}\5\d{5})(?!\d))"
    r"|(?P<phone>(?<![\w+])(?:\+1[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\w+])\+1[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w+])\+[2-9]\d{0,2}(?:[ -]\d{2,4}){2,4}(?![\d.])|(?<![\w+.-])\d{3}([.-])\d{3}\7\d{4}(?![\d-]))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<date>(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?!\d|[/.-]\d))",
    re.ASCII,
)
_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _number(values: list[int], radices: list[int]) -> tuple[int, int]:
    n = size = 0
    size = 1
    for v, r in zip(values, radices, strict=True):
        n, size = n * r + v, size * r
    return n, size


def _symbols(n: int, radices: list[int]) -> list[int]:
    out = []
    for r in reversed(radices):
        n, v = divmod(n, r)
        out.append(v)
    return out[::-1]


def _f(key: bytes, kind: str, turn: int, half: int, size: int, modulus: int) -> int:
    """A keyed number below ``modulus``; eight bytes more than it has keep the bias negligible."""
    need, out, block = (modulus.bit_length() + 7) // 8 + 8, b"", 0
    while len(out) < need:
        out += hashlib.blake2b(f"{kind}|{turn}|{half}|{size}|{modulus}|{block}".encode(), key=key[:64], digest_size=64).digest()
        block += 1
    return int.from_bytes(out[:need], "big") % modulus


def feistel(n: int, left: int, right: int, key: bytes, kind: str, back: bool = False) -> int:
    """A permutation of the numbers below left x right."""
    a, b = divmod(n, right)
    for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if turn % 2 == 0:
            a = (a + (-1 if back else 1) * _f(key, kind, turn, b, right, left)) % left
        else:
            b = (b + (-1 if back else 1) * _f(key, kind, turn, a, left, right)) % right
    return a * right + b


def permute(text: str, key: bytes, kind: str, back: bool = False) -> str:
    """Letters and digits of ``text`` permuted together; all else, and the case, stays."""
    at = [i for i, c in enumerate(text) if c.isascii() and c.isalnum()]
    if not at:
        return text
    radices = [10 if text[i].isdigit() else 26 for i in at]
    values = [ord(text[i]) - 48 if text[i].isdigit() else ord(text[i].lower()) - 97 for i in at]
    half = len(at) // 2
    _, left = _number([0] * half, radices[:half])
    _, right = _number([0] * (len(at) - half), radices[half:])
    n, _ = _number(values, radices)
    out = list(text)
    for i, v, r in zip(at, _symbols(feistel(n, left, right, key, kind, back), radices), radices, strict=True):
        out[i] = chr(48 + v) if r == 10 else chr(v + (65 if text[i].isupper() else 97))
    return "".join(out)


def _refill(text: str, digits: str) -> str:
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in text)


def _card(text: str, key: bytes, back: bool) -> str | None:
    digits = re.sub(r"\D", "", text)
    if luhn(digits[:-1]) != int(digits[-1]):
        return None
    body = permute(digits[:-1], key, "card", back)
    return _refill(text, body + str(luhn(body)))


def _ipv4(text: str, key: bytes, back: bool) -> str | None:
    parts = text.split(".")
    octets = bytes(x if (x := int(p)) < 256 else 0 for p in parts)
    padded = any(len(p) > 1 and p[0] == "0" for p in parts)
    # Written without leading zeros, or with three digits each.
    form = "{:03d}" if padded else "{:d}"
    if ".".join(map(form.format, octets)) != text:
        return None
    n = int.from_bytes(octets, "big")
    while True:
        n = feistel(n, 1 << 16, 1 << 16, key, "ipv4", back)
        # Addresses with an octet below 100 are permuted among themselves, so both forms stay apart and their values linked.
        new = n.to_bytes(4, "big")
        if (min(new) < 100) == (min(octets) < 100):
            return ".".join(map(form.format, new))


def _phone(text: str, key: bytes, back: bool) -> str | None:
    digits = re.sub(r"\D", "", text)
    code = re.match(r"\+\d{1,3}(?=[ .(-])|\+1", text)
    keep = len(code[0]) - 1 if code else 0
    if not 7 <= len(digits) - keep <= 14:
        return None
    return _refill(text, digits[:keep] + permute(digits[keep:], key, "phone", back))


def _ssn(text: str, key: bytes, back: bool) -> str | None:
    valid = lambda x: x[:3] not in ("000", "666") and x[0] != "9" and x[4:6] != "00" and x[7:] != "0000"
    if not valid(text):
        return None
    new = permute(text, key, "ssn", back)
    while not valid(new):
        new = permute(new, key, "ssn", back)
    return new


def _date(text: str, key: bytes, back: bool) -> str | None:
    parts = [int(x) for x in re.split(r"\D", text)]
    order = (0, 1, 2) if text[4] == "-" else (2, 0, 1) if text[2] == "/" else (2, 1, 0)
    if text[2] == "/" and parts[0] > 12:
        order = (2, 1, 0)
    try:
        day = datetime.date(*(parts[i] for i in order)).toordinal()
    except ValueError:
        return None
    if not _FIRST <= day <= _LAST:
        return None
    form = {(0, 1, 2): "%Y-%m-%d", (2, 0, 1): "%m/%d/%Y", (2, 1, 0): f"%d{text[2]}%m{text[2]}%Y"}[order]
    # Days beyond the 12th are permuted among themselves, whatever the form: dates written day/month are those that can't be
    # month/day, and one day keeps one pseudonym in all forms.
    late, side, n = datetime.date.fromordinal(day).day > 12, 271, day - _FIRST
    while True:
        n = feistel(n, side, side, key, "date", back)
        if n <= _LAST - _FIRST and ((new := datetime.date.fromordinal(n + _FIRST)).day > 12) == late:
            return new.strftime(form)


def _email(text: str, key: bytes, back: bool) -> str | None:
    local, _, domain = text.rpartition("@")
    return f"{permute(local, key, 'email', back)}@{domain}"


_MAKERS = {"email": _email, "card": _card, "phone": _phone, "ipv4": _ipv4, "ssn": _ssn, "date": _date}


@lru_cache(50_000)
def pseudonym(kind: str, text: str, key: bytes, back: bool = False) -> str | None:
    """The pseudonym of a value, or None if it isn't valid."""
    return _MAKERS[kind](text, key, back)


_SEED, _BLANK = re.compile("[0-9@]"), re.compile(r"\s")


def windows(text: str) -> list[tuple[int, int]]:
    """Where findings can be: words with a digit or @, joined to the next over at most two blanks."""
    out: list[list[int]] = []
    at = 0
    while m := _SEED.search(text, at):
        low = out[-1][1] if out else 0
        start = m.start()
        while start > low and not text[start - 1].isspace():
            start -= 1
        stop = _BLANK.search(text, m.end())
        at = stop.start() if stop else len(text)
        if out and start - out[-1][1] <= 2:
            out[-1][1] = at
        else:
            out.append([start, at])
    return [(a, b) for a, b in out]


def replace(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and kind, start and end of what was replaced."""
    out, found, at = [], [], 0
    for start, stop in windows(text):
        for m in _FINDER.finditer(text, start, stop):
            new = pseudonym(m.lastgroup, m[0], key, back)
            if new is not None:
                out += [text[at : m.start()], new]
                found.append((m.lastgroup, m.start(), m.end()))
                at = m.end()
    out.append(text[at:])
    return "".join(out), found


RESULT = "struct<text:string, spans:array<struct<kind:string, start:long, stop:long>>>"
_KIND = pa.struct([("text", pa.string()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])))])


def pseudonymize(docs: DataFrame, key: bytes, *, text: str = "text", out: str = "pii", back: bool = False) -> DataFrame:
    """``docs`` with a column ``out``: the new text, and the spans replaced in the old one. No shuffle."""
    if not key:
        raise ValueError("pseudonyms need a key")

    @F.arrow_udf(RESULT)
    def replaced(column: pa.Array) -> pa.Array:
        may = pc.fill_null(pc.match_substring_regex(column, "[0-9@]"), False).to_pylist()
        rows = []
        for old, look in zip(column.to_pylist(), may, strict=True):
            new, found = replace(old, key, back) if look else (old, [])
            rows.append({"text": new, "spans": [{"kind": k, "start": a, "stop": b} for k, a, b in found]})
        return pa.array(rows, _KIND)

    return docs.withColumn(out, replaced(F.col(text)))


def restore(docs: DataFrame, key: bytes, *, text: str = "text", out: str = "pii") -> DataFrame:
    """The inverse: pseudonyms back to values."""
    return pseudonymize(docs, key, text=text, out=out, back=True)
