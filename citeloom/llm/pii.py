"""Personal data: validated values are replaced by format-preserving pseudonyms.

Each kind has a pattern, a validator and a set of values it may take. A value is an integer in that
set; a keyed Feistel network permutes the set (walking on while a result falls outside) and the
result is written in the value's own format. The permutation depends on the key and the kind alone,
so equal values keep equal pseudonyms in every document, in whatever grouping they are written, and
who has the key can undo it (``restored``). No value is its own pseudonym. Numbers that fail their
check (Luhn, mod 97, calendar, octets) are left alone.

Letters and digits of any script are permuted among those of the same kind (category) in their row of
128 code points. Of an e-mail address the part before the @ is replaced; the domain stays. A value none
of whose characters can change is left alone and not counted.

Defined results: null text stays null; empty text stays empty; a text without findings is returned
as it is; where findings overlap the kind named first in ``KINDS`` wins; rows are treated one by
one; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame

ROUNDS = 10
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
LOWER_MORE = "".join(c for c in map(chr, range(0xDF, 0x100)) if c.islower())
UPPER_MORE = "".join(c for c in map(chr, range(0xC0, 0xDF)) if c.isupper())
HEX = {"0123456789abcdef": re.compile(r"[0-9a-f]+"), "0123456789ABCDEF": re.compile(r"[0-9A-F]+")}
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """A keyed permutation of 0 .. size - 1 for each kind and size."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, kind: str, size: int, i: int, half: int) -> int:
        data = f"{kind}|{size}|{i}|{half}".encode()
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=32).digest(), "big")

    def __call__(self, kind: str, value: int, size: int, back: bool = False) -> int:
        if size < 2:
            return value
        a = isqrt(size - 1) + 1
        b = -(-size // a)
        while True:
            left, right = divmod(value, b)  # left below a, right below b
            steps = range(ROUNDS)[::-1] if back else range(ROUNDS)
            for i in steps:
                if i % 2:
                    shift = self._round(kind, size, i, left)
                    right = (right - shift) % b if back else (right + shift) % b
                else:
                    shift = self._round(kind, size, i, right)
                    left = (left - shift) % a if back else (left + shift) % a
            value = left * b + right
            if value < size:
                return value

    def away(self, kind: str, value: int, size: int) -> int:
        """A permutation without fixed points: one step along the cycle that the keyed permutation makes."""
        return self(kind, (self(kind, value, size) + 1) % size, size, back=True)

    def home(self, kind: str, value: int, size: int) -> int:
        """The inverse of ``away``."""
        return self(kind, (self(kind, value, size) - 1) % size, size, back=True)


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_check(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


@lru_cache(maxsize=4096)
def _alphabet(c: str) -> str:
    """What may stand in the place of a character; only itself if it is no letter or digit."""
    own = next((a for a in (LOWER, UPPER, DIGITS, LOWER_MORE, UPPER_MORE) if c in a), "")
    if own or ord(c) < 0x100 or not c.isalnum():
        return own or c
    row = map(chr, range(ord(c) & ~127, (ord(c) | 127) + 1))
    return "".join(x for x in row if x.isalnum() and unicodedata.category(x) == unicodedata.category(c))


def spelled(permute: Callable[[int, int], int], text: str, alphabets: list[str]) -> str | None:
    """Permute a string whose every character may take the values of its own alphabet; None if none can change."""
    value, size = 0, 1
    for c, a in zip(text, alphabets, strict=True):
        value, size = value * len(a) + a.index(c), size * len(a)
    if size < 2:
        return None
    value, out = permute(value, size), []
    for a in reversed(alphabets):
        value, d = divmod(value, len(a))
        out.append(a[d])
    return "".join(reversed(out))


def digits_in(pattern: str, new: str) -> str:
    """``new`` digits in the places of ``pattern``'s digits."""
    rest = iter(new)
    return "".join(next(rest) if c.isdigit() else c for c in pattern)


# -- kinds: (name, pattern, pseudonym of a match or None if it isn't valid) ----------------------

Permute = Callable[[str, int, int], int]


def _email(m: re.Match, p: Permute) -> str | None:
    local = m[1]
    new = spelled(lambda v, n: p("email" + re.sub(r"[^\W_]", "", local), v, n), local, [_alphabet(c) for c in local])
    return new and new + m[2]


def _secret(m: re.Match, p: Permute) -> str | None:
    value = m[2]
    own = next((a for a, pattern in HEX.items() if pattern.fullmatch(value)), None)
    return m[1] + spelled(lambda v, n: p("secret", v, n), value, [own or _alphabet(c) for c in value])


def _iban(m: re.Match, p: Permute) -> str | None:
    plain = m[0].replace(" ", "")
    if iban_check(plain[:2], plain[4:]) != plain[2:4]:
        return None
    body = spelled(lambda v, n: p("iban" + plain[:2], v, n), plain[4:], [_alphabet(c) for c in plain[4:]])
    rest = iter(plain[:2] + iban_check(plain[:2], body) + body)
    return "".join(c if c == " " else next(rest) for c in m[0])


def _card(m: re.Match, p: Permute) -> str | None:
    plain = re.sub(r"[ -]", "", m[0])
    payload = plain[:-1]
    if luhn_digit(payload) != plain[-1] or len(set(plain)) == 1:
        return None
    new = f"{p('card', int(payload), 10 ** len(payload)):0{len(payload)}d}"
    return digits_in(m[0], new + luhn_digit(new))


def _phone(m: re.Match, p: Permute) -> str | None:
    plain = re.sub(r"\D", "", m[2])
    if not 7 <= len(plain) <= 13:
        return None
    return m[1] + digits_in(m[2], f"{p('phone', int(plain), 10 ** len(plain)):0{len(plain)}d}")


def _ssn(m: re.Match, p: Permute) -> str | None:
    area, group, serial = int(m[1]), int(m[2]), int(m[3])
    if not (0 < area < 900 and area != 666 and group and serial):
        return None
    value = p("ssn", ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999)
    value, serial = divmod(value, 9999)
    area, group = divmod(value, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _date(m: re.Match, p: Permute) -> str | None:
    order = ("y", "m", "d") if m["y1"] else ("d", "m", "y")
    try:
        day = datetime.date(int(m["y1"] or m["y2"]), int(m["m1"] or m["m2"]), int(m["d1"] or m["d2"])).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    new = datetime.date.fromordinal(FIRST_DAY + p("date", day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1))
    part = {"y": f"{new.year}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
    return (m["s1"] or m["s2"]).join(part[x] for x in order)


def _ip(m: re.Match, p: Permute) -> str | None:
    octets = [int(x) for x in m[0].split(".")]
    if max(octets) > 255:
        return None
    new = p("ip", int.from_bytes(bytes(octets), "big"), 1 << 32)
    return ".".join(map(str, new.to_bytes(4, "big")))


KINDS: list[tuple[str, re.Pattern, Callable[[re.Match, Permute], str | None]]] = [
    ("email", re.compile(r"(?<![\w.%+-])([^\W_][\w.%+-]*)(@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"), _email),
    ("secret", re.compile(r"(?i)(\b(?:password|passwd|token|secret|api[_-]?key)\s*[=:]\s*[\"']?)([A-Za-z0-9]{8,})"), _secret),
    ("secret", re.compile(r"\b(AKIA)([A-Z0-9]{16})\b"), _secret),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b"), _iban),
    ("card", re.compile(r"(?<!\d)\d{13,19}(?!\d)"), _card),
    ("card", re.compile(r"(?<!\d)\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}(?!\d)|(?<!\d)\d{4}([ -])\d{6}\2\d{5}(?!\d)"), _card),
    ("phone", re.compile(r"(\+\d{1,3}[ .-]?)((?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4})(?!\d)"), _phone),
    ("phone", re.compile(r"()((?:\(\d{3}\) ?|(?<!\d)\d{3}-)\d{3}-\d{4})(?!\d)"), _phone),
    ("ssn", re.compile(r"(?<![\d-])(\d{3})-(\d{2})-(\d{4})(?![\d-])"), _ssn),
    (
        "date",
        re.compile(
            r"(?<![\d.-])(?:(?P<y1>\d{4})(?P<s1>[-/.])(?P<m1>\d{2})(?P=s1)(?P<d1>\d{2})|(?P<d2>\d{2})(?P<s2>[-/.])(?P<m2>\d{2})(?P=s2)(?P<y2>\d{4}))(?!\d|[-.]\d)"
        ),
        _date,
    ),
    ("ip", re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"), _ip),
]
NAMES = tuple(dict.fromkeys(name for name, _, _ in KINDS))
_ANY = re.compile(r"[\d@=:]")


def findings(text: str, permute: Permute) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of all valid values, in order, without overlaps."""
    if not _ANY.search(text):
        return []
    out: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))
    for name, pattern, make in KINDS:
        for m in pattern.finditer(text):
            if 1 in taken[m.start() : m.end()]:
                continue
            new = make(m, permute)
            if new is not None:
                out.append((m.start(), m.end(), name, new))
                taken[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    return sorted(out)


def replaced(text: str, found: list[tuple[int, int, str, str]]) -> str:
    parts, at = [], 0
    for a, b, _, new in found:
        parts += [text[at:a], new]
        at = b
    return "".join([*parts, text[at:]])


def restored(text: str, key: bytes) -> str:
    """The text that ``pseudonymize`` was given, from its result and the key."""
    return replaced(text, findings(text, Feistel(key).home))


def pseudonymize(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, a count for each kind (n_email and so on), n_replaced, and the text with pseudonyms."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"n_{n} long" for n in (*NAMES, "replaced")) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]):
        permute = Feistel(key).away
        for batch in batches:
            texts, counts = [], {n: [] for n in NAMES}
            for text in batch.column(1).to_pylist():
                found = findings(text, permute) if text else []
                for n in NAMES:
                    counts[n].append(sum(f[2] == n for f in found) if found else 0)
                texts.append(replaced(text, found) if found else text)
            total = [sum(x) for x in zip(*counts.values(), strict=True)]
            arrays = [batch.column(0), *(pa.array(counts[n], pa.int64()) for n in NAMES), pa.array(total, pa.int64()), pa.array(texts, pa.string())]
            yield pa.record_batch(arrays, names=["doc_id", *(f"n_{n}" for n in NAMES), "n_replaced", "text"])

    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, schema)
