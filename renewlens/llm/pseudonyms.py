"""Format-preserving pseudonyms: personal numbers, dates and addresses permuted under a key."""

from __future__ import annotations

import calendar
import datetime
import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from renewlens.llm.text import slices

ROUNDS = 8
KINDS = ("email", "ip", "phone", "card", "ssn", "iban", "date")

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Digits are those of ASCII. The name of an address has 64 characters at most, so no run of letters is
#: gone through more than 64 times. Candidates; each is validated before it counts. Order decides where two could start at one place.
PATTERN = re.compile(
    r"(?P<email>[A-Za-z0-9._%+-]{0,63}[A-Za-z0-9]@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?<![A-Za-z0-9])(?P<iban>[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
    r"|(?<![\w.])(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![\w]|\.[0-9])"
    r"|(?<![\w/.-])(?P<date>[0-9]{4}(?P<s>[-/.])[0-9]{1,2}(?P=s)[0-9]{1,2}|[0-9]{1,2}(?P<t>[-/.])[0-9]{1,2}(?P=t)[0-9]{4})(?![\w/]|[.-][0-9])"
    r"|(?<![\w-])(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w-])"
    r"|(?<![\w+])(?P<card>[0-9](?:[\x20-]?[0-9]){12,18})(?!\w)"
    r"|(?<![\w+])(?P<phone>(?:\+?1[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}"
    r"|\+[0-9](?:[\x20().-]{0,2}[0-9]){7,14})(?!\w)"
)
_WORTH = re.compile(r"[0-9@]")
#: Days of a date stay within its span: the last two centuries, or what lies around them.
_SPANS = ((1, 1899), (1900, 2099), (2100, 9999))


class Feistel:
    """Keyed permutations of the numbers below any size."""

    def __init__(self, key: bytes):
        if not key:
            raise ValueError("a key is needed")
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def permute(self, value: int, size: int, tweak: str, back: bool = False) -> int:
        """Map a number below ``size`` to another one; ``tweak`` separates kinds of values.

        A balanced network runs over the next even number of bits; results outside are sent through
        again until one is inside, which keeps the map one-to-one.
        """
        if not 0 <= value < size:
            raise ValueError("value out of range")
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        rounds = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
        while True:
            value = self._pass(value, half, f"{tweak}:{size}".encode(), rounds, back)
            if value < size:
                return value

    def _pass(self, value: int, half: int, tweak: bytes, rounds: range, back: bool) -> int:
        mask = (1 << half) - 1
        a, b = value >> half, value & mask
        width = (half + 7) // 8
        for r in rounds:
            seen = a if back else b
            text = bytes([r]) + seen.to_bytes(width, "big") + tweak
            mixed = hashlib.blake2b(text, key=self.key, digest_size=min(64, width + 8)).digest()
            mixed = int.from_bytes(mixed, "big") & mask
            a, b = (b ^ mixed, a) if back else (b, a ^ mixed)
        return (a << half) | b


def luhn(digits: str) -> int:
    """Check digit that follows ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _refill(layout: str, letters: str) -> str:
    """Put characters in the places of the letters and digits of a layout."""
    left = iter(letters)
    return "".join(next(left) if c.isalnum() else c for c in layout)


class Pseudonyms:
    """Pseudonyms of validated values. None where a candidate is not valid."""

    def __init__(self, key: bytes):
        self.feistel = Feistel(key)
        # equal values come often; the cache holds the latest only
        self.replace = lru_cache(maxsize=100_000)(self._replace)

    def _replace(self, kind: str, text: str) -> str | None:
        return getattr(self, f"_{kind}")(text)

    def _by_class(self, text: str, tweak: str) -> str:
        """Permute the letters and digits of a text, each within its class."""
        sets = [next((s for s in (_DIGITS, _LOWER, _UPPER) if c in s), None) for c in text]
        value, size = 0, 1
        for c, s in zip(text, sets):
            if s:
                value, size = value * len(s) + s.index(c), size * len(s)
        value, out = self.feistel.permute(value, size, tweak), []
        for c, s in zip(reversed(text), reversed(sets)):
            if s:
                value, at = divmod(value, len(s))
                c = s[at]
            out.append(c)
        return "".join(reversed(out))

    def _email(self, text: str) -> str:
        local, _, domain = text.rpartition("@")
        return f"{self._by_class(local, 'email:' + domain.lower())}@{domain}"

    def _ip(self, text: str) -> str | None:
        parts = [int(x) for x in text.split(".")]
        if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
            return None
        # unicast addresses among themselves, the reserved and multicast ones likewise
        heads = range(1, 224) if 1 <= parts[0] <= 223 else (0, *range(224, 256))
        value = heads.index(parts[0]) << 24 | parts[1] << 16 | parts[2] << 8 | parts[3]
        value = self.feistel.permute(value, len(heads) << 24, "ip")
        return ".".join(map(str, (heads[value >> 24], value >> 16 & 255, value >> 8 & 255, value & 255)))

    def _phone(self, text: str) -> str | None:
        digits = "".join(c for c in text if c.isdigit())
        lead = "1" if len(digits) == 11 and digits[0] == "1" else ""
        core = digits[len(lead):]
        if len(core) == 10 and (lead or not text.startswith("+")):
            # numbers of the assigned kind stay so, and others stay others
            assigned = lambda x: x[0] > "1" and x[3] > "1"
            kind, new = assigned(core), core
            while new == core or assigned(new) != kind:
                new = f"{self.feistel.permute(int(new), 10**10, 'phone'):010d}"
                if new == core:
                    break
            return _refill(text, lead + new)
        if not text.startswith("+") or not 8 <= len(digits) <= 15:
            return None
        return _refill(text, digits[:2] + self._by_class(digits[2:], "phone:" + digits[:2]))

    def _card(self, text: str) -> str | None:
        digits = "".join(c for c in text if c.isdigit())
        if digits[0] == "0" or luhn(digits[:-1]) != int(digits[-1]):
            return None
        body = digits[0] + self._by_class(digits[1:-1], f"card:{digits[0]}")
        return _refill(text, body + str(luhn(body)))

    def _ssn(self, text: str) -> str | None:
        area, group, serial = map(int, text.split("-"))
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        place = area - 1 - (area > 666)
        value = self.feistel.permute((place * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "ssn")
        place, rest = divmod(value, 99 * 9999)
        area = place + 1 + (place >= 665)
        return f"{area:03d}-{rest // 9999 + 1:02d}-{rest % 9999 + 1:04d}"

    def _iban(self, text: str) -> str | None:
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
            return None
        body = self._by_class(plain[4:], "iban:" + plain[:2])
        return _refill(text, f"{plain[:2]}{98 - _mod97(body + plain[:2] + '00'):02d}{body}")

    def _date(self, text: str) -> str | None:
        sign = next(c for c in text if not c.isdigit())
        parts = text.split(sign)
        order = "ymd" if len(parts[0]) == 4 else "dmy"
        found = _day(parts, order) or (_day(parts, "mdy") if order == "dmy" else None)
        if found is None:
            return None
        if order == "dmy" and _day(parts, "dmy") is None:
            order = "mdy"
        low, high = next(s for s in _SPANS if s[0] <= found.year <= s[1])
        first = datetime.date(low, 1, 1).toordinal()
        size = datetime.date(high, 12, 31).toordinal() - first + 1
        new = datetime.date.fromordinal(first + self.feistel.permute(found.toordinal() - first, size, f"date:{low}"))
        padded = all(len(p) == 2 for p in parts if len(p) != 4)
        values = {"y": f"{new.year:04d}", "m": f"{new.month:02d}" if padded else str(new.month),
                  "d": f"{new.day:02d}" if padded else str(new.day)}
        return sign.join(values[c] for c in order)

    def text(self, text: str, counts: Counter) -> str:
        """A text with the pseudonyms of all its valid values, counted by kind."""

        def put(match: re.Match) -> str:
            kind, old = match.lastgroup if match.lastgroup in KINDS else "date", match.group()
            new = self.replace(kind, old)
            if new is None and kind == "card":
                new, kind = self.replace("phone", old), "phone"
            if new is None:
                return old
            counts[kind] += 1
            return new

        return PATTERN.sub(put, text)


def _day(parts: list[str], order: str) -> datetime.date | None:
    value = dict(zip(order, map(int, parts)))
    y, m, d = value["y"], value["m"], value["d"]
    if not (1 <= y and 1 <= m <= 12 and 1 <= d <= calendar.monthrange(y, m)[1]):
        return None
    return datetime.date(y, m, d)


def pseudonymise(docs: DataFrame, key: bytes, column: str = "text") -> DataFrame:
    """``docs`` with every valid value in ``column`` replaced, and n_<kind> counts.

    Equal values get equal pseudonyms in all documents under one key, whatever the separators of a
    phone number, card or date. Candidates that fail validation stay. A null text stays null, with
    counts of 0. Columns of ``docs`` under the new names have to be shielded by the caller.
    """
    names = docs.columns
    added = [f"n_{k}" for k in KINDS]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_of: Callable[[str, Counter], str] = Pseudonyms(key).text
        for batch in slices(batches, column):
            texts, counts = batch.column(column).to_pylist(), [Counter() for _ in range(batch.num_rows)]
            for i, text in enumerate(texts):
                if text and _WORTH.search(text):
                    texts[i] = names_of(text, counts[i])
            columns = [pa.array(texts, pa.string()) if c == column else batch.column(c) for c in names]
            columns += [pa.array([c[k] for c in counts], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])

    return docs.mapInArrow(run, schema)
