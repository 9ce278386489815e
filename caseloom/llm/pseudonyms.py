"""Format-preserving pseudonyms: keyed Feistel permutations of numbers, letters and dates within their format.

The symbols of a *normalised* value are permuted by a keyed Feistel network over their alphabet and written back into the
value's own format, so that the same value gets the same pseudonym in every document however it was punctuated, and the
permutation can be undone with the key. Values that must stay valid are cycle-walked: the permutation is applied again until
its result is valid, which keeps it one-to-one. Words (names, street names, mail addresses) have no format of their own and get
a keyed 128-bit code of the normalised text.

Defined results: a single symbol goes through a keyed permutation of its alphabet; nothing stays nothing; signs stay in place.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from datetime import date
from functools import lru_cache

DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ROUNDS = 10
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
# English months, for dates written in words.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def _round_value(key: bytes, tweak: bytes, number: int, modulus: int) -> int:
    size = (number.bit_length() + 7) // 8 + 1
    return int.from_bytes(hashlib.blake2b(number.to_bytes(size, "big") + tweak, key=key, digest_size=24).digest(), "big") % modulus


@lru_cache(maxsize=64)
def _shuffled(key: bytes, tweak: bytes, alphabet: str) -> str:
    return "".join(sorted(alphabet, key=lambda c: (_round_value(key, tweak, ord(c), 1 << 64), c)))


def _number(symbols: str, alphabet: str) -> int:
    n = 0
    for c in symbols:
        n = n * len(alphabet) + alphabet.index(c)
    return n


def _symbols(n: int, width: int, alphabet: str) -> str:
    out = []
    for _ in range(width):
        n, r = divmod(n, len(alphabet))
        out.append(alphabet[r])
    return "".join(reversed(out))


def feistel(symbols: str, key: bytes, tweak: bytes = b"", alphabet: str = DIGITS, inverse: bool = False) -> str:
    """A keyed permutation of the strings of this length over an alphabet (alternating Feistel over a left and a right part)."""
    n = len(symbols)
    if n < 2:
        there, back = (_shuffled(key, tweak, alphabet), alphabet) if not inverse else (alphabet, _shuffled(key, tweak, alphabet))
        return there[back.index(symbols)] if symbols else ""
    u = n // 2
    a, b = _number(symbols[:u], alphabet), _number(symbols[u:], alphabet)
    sizes = (len(alphabet) ** u, len(alphabet) ** (n - u))
    tweak = tweak + n.to_bytes(4, "big")
    for r in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        turn = tweak + r.to_bytes(1, "big")
        if r % 2 == 0:
            step = _round_value(key, turn, b, sizes[0])
            a = (a + (-step if inverse else step)) % sizes[0]
        else:
            step = _round_value(key, turn, a, sizes[1])
            b = (b + (-step if inverse else step)) % sizes[1]
    return _symbols(a, u, alphabet) + _symbols(b, n - u, alphabet)


def permute_within(value: str, key: bytes, tweak: bytes, keep: int = 0, inverse: bool = False) -> str:
    """Permutes the digits, and the letters, of a written value and puts them back into its format; the first ``keep`` digits stay."""
    digits = "".join(c for c in value if c in DIGITS)
    letters = "".join(c.lower() for c in value if c.lower() in LETTERS)
    fresh_digits = iter(digits[:keep] + feistel(digits[keep:], key, tweak, inverse=inverse))
    fresh_letters = iter(feistel(letters, key, tweak + b"letters", LETTERS, inverse))
    out = []
    for c in value:
        if c in DIGITS:
            out.append(next(fresh_digits))
        elif c.lower() in LETTERS:
            fresh = next(fresh_letters)
            out.append(fresh.upper() if c.isupper() else fresh)
        else:
            out.append(c)
    return "".join(out)


def permute_valid(value: str, key: bytes, tweak: bytes, valid: Callable[[str], bool], keep: int = 0) -> str:
    """Cycle-walks the permutation until the value is valid in its format again, so that it stays one-to-one."""
    fresh = permute_within(value, key, tweak, keep)
    while not valid(fresh):
        fresh = permute_within(fresh, key, tweak, keep)
    return fresh


def permute_date(value: date, key: bytes, first: date = FIRST_DAY, last: date = LAST_DAY, inverse: bool = False) -> date:
    """A keyed permutation of the days between first and last: cycle-walking over day numbers."""
    span = (last - first).days + 1
    width = len(str(span - 1))
    n = (value - first).days
    while True:
        n = int(feistel(f"{n:0{width}d}", key, b"date", inverse=inverse))
        if n < span:
            return date.fromordinal(first.toordinal() + n)


_NUMERIC_DATE = re.compile(r"(?P<a>\d{1,4})(?P<s>[/.-])(?P<b>\d{1,2})(?P=s)(?P<c>\d{2,4})$")
_WORDED_DATE = re.compile(r"(?P<m>[A-Za-z]{3,9})\.?\s+(?P<d>\d{1,2})(?:st|nd|rd|th)?,?\s+(?P<y>\d{4})$")


def read_date(written: str) -> tuple[date, Callable[[date], str]] | None:
    """The day a date writes (month first, or year first) and a function that writes another day the same way; null if no date."""
    m = _NUMERIC_DATE.match(written)
    try:
        if m:
            a, s, b, c = m["a"], m["s"], m["b"], m["c"]
            if len(a) == 4:
                day = date(int(a), int(b), int(c))
                put = lambda d: f"{d.year}{s}{d.month:0{len(b)}d}{s}{d.day:0{len(c)}d}"
            elif len(c) == 4 and len(a) <= 2:
                day = date(int(c), int(a), int(b))
                put = lambda d: f"{d.month:0{len(a)}d}{s}{d.day:0{len(b)}d}{s}{d.year}"
            else:
                return None
        elif m := _WORDED_DATE.match(written):
            name, full = m["m"], [x for x in MONTHS if x.startswith(m["m"].lower())]
            if len(full) != 1:
                return None
            day, short = date(int(m["y"]), MONTHS.index(full[0]) + 1, int(m["d"])), len(name) < len(full[0])
            put = lambda d: f"{(MONTHS[d.month - 1][:3] if short else MONTHS[d.month - 1]).capitalize()} {d.day}, {d.year}"
        else:
            return None
    except ValueError:
        return None
    return (day, put) if FIRST_DAY <= day <= LAST_DAY else None


def code(value: str, key: bytes, kind: str) -> str:
    """A keyed 128-bit code of a word value, equal for equal normalised values."""
    plain = re.sub(r"[\s.]+", " ", value.strip().lower())
    return hashlib.blake2b(plain.encode(), key=key, person=kind.encode()[:16].ljust(16, b"\0"), digest_size=16).hexdigest()
