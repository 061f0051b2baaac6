"""Personal data replaced by format-preserving Feistel pseudonyms.

A value is found by its shape and validated (Luhn, mod 97, octets, calendar, number ranges); its place in the list of all
values of its format is permuted under a key and the value at the new place is written in the same format, separators included.
Equal values get equal pseudonyms in all documents, different values different ones, and with the key each can be turned back.

The permutation is a Feistel network on pairs of residues with cycle walking down to the format's size, E; the pseudonym of x is
E^-1(E(x) + 1), one cycle through all values, so no value is its own pseudonym however small its format is.

Kinds: card, iban, ssn, ip (both versions), date, phone, email (its local part), secret (access keys, tokens with a known
beginning, and passwords and tokens after their name).

A date's format is its separator, order and number of digits: the pseudonym of 1.2.2003 has one digit for day and month too. With
year last and `/` or `-`, month comes first unless only day first is a date. Dates of equal digits are linked over all separators
and orders; 1.2.2003 and 01.02.2003 aren't. Letters beyond ASCII are replaced by letters of their kind and script.

Defined results: a null text stays null with no values; texts and values are read whole; repeated rows get equal results; dates
before 1900 or after 2099 and values that fail validation stay; further columns are ignored.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandlog.llm import common as C

ROUNDS = 10
#: Characters that are permuted as one number; longer secrets are cut into blocks.
BLOCK = 200
LOWER, UPPER, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
HEX = "0123456789abcdef"
FIRST_DAY, DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal() - datetime.date(1900, 1, 1).toordinal() + 1
#: Without one of these no value can be in a text.
HINT = re.compile(r"[0-9@=:]|AKIA|ASIA|[bB]earer|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|[sr]k[-_]")
VALUE = re.compile(
    r"""(?P<secret>(?i:\b(?:(?:password|passwd|pwd)\b["']?\s?[=:]\s?["']?(?=[A-Za-z0-9_+/-]{4})|(?:secret|token|api[_-]?key)\b["']?\s?[=:]\s?["']?(?=[A-Za-z0-9_+/-]{8})|bearer\s(?=[A-Za-z0-9_+/.-]{16})))(?P<code>[A-Za-z0-9_+/-]++(?:\.[A-Za-z0-9_+/-]++)*+)"""
    r"""|(?<![A-Za-z0-9])(?:(?P<access>(?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Za-z0-9])|(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|[sr]k-|[sr]k_live_|[sr]k_test_)(?P<known>[A-Za-z0-9_-]{16,}+)))"""
    r"""|(?P<email>(?<![\w.%+\u0300-\u036f-])(?P<local>[\w.%+\u0300-\u036f-]++)@[^\W_](?:[\w\u0300-\u036f-]*+\.)+[^\W\d_]{2,})"""
    r"""|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"""
    r"""|(?P<ip>(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9]))"""
    r"""|(?P<ip6>(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]))"""
    r"""|(?P<date>(?<![0-9])(?:[0-9]{4}(?P<a>[-/.])[0-9]{1,2}(?P=a)[0-9]{1,2}|[0-9]{1,2}(?P<b>[-/.])[0-9]{1,2}(?P=b)[0-9]{4})(?![0-9]))"""
    r"""|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"""
    r"""|(?P<phone>\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,5}){1,4}(?![0-9]|[-./:][0-9])|(?<![0-9+])(?:\([2-9][0-9]{2}\)\x20?|[2-9][0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]))"""
    r"""|(?P<card>(?<![0-9])(?:[0-9]{4}(?P<gap>[ -])[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{1,7}|[0-9]{4}(?P<bar>[ -])[0-9]{6}(?P=bar)[0-9]{5}|[0-9]{13,19})(?![0-9]))"""
)


class Permutation:
    """A keyed permutation of 0 .. size - 1 for any size, and the pseudonym cycle on it."""

    def __init__(self, key: bytes, tag: str, size: int) -> None:
        self.size, self.side, self.tag = size, isqrt(size - 1) + 1, tag.encode()
        self.width = (self.side.bit_length() + 7) // 8
        self.key = hashlib.blake2b(key, person=b"pseudonym").digest()

    def _round(self, i: int, half: int) -> int:
        text = self.tag + b"\0" + bytes([i]) + half.to_bytes(self.width, "little")
        return int.from_bytes(hashlib.shake_256(self.key + text).digest(self.width + 8), "little")

    def forward(self, x: int) -> int:
        while True:
            left, right = divmod(x, self.side)
            for i in range(ROUNDS):
                left, right = right, (left + self._round(i, right)) % self.side
            x = left * self.side + right
            if x < self.size:
                return x

    def back(self, x: int) -> int:
        while True:
            left, right = divmod(x, self.side)
            for i in reversed(range(ROUNDS)):
                left, right = (right - self._round(i, left)) % self.side, left
            x = left * self.side + right
            if x < self.size:
                return x

    def pseudonym(self, x: int, by: int = 1) -> int:
        return self.back((self.forward(x) + by) % self.size)


def luhn(digits: str) -> int:
    """The digit that makes `digits` followed by it valid."""
    twice = [int(x) * 2 for x in digits[::-2]]
    return -(sum(x - 9 * (x > 9) for x in twice) + sum(map(int, digits[-2::-2]))) % 10


@lru_cache(maxsize=4096)
def alphabet(c: str) -> str:
    """The letters that may stand for c, itself among them; empty for what is no letter or digit."""
    if c.isascii():
        return next((a for a in (LOWER, UPPER, DIGIT) if c in a), "")
    kind = unicodedata.category(c)
    if kind[0] not in "LNM":
        return ""
    return "".join(x for x in map(chr, range(max(ord(c) & ~0xFF, 128), (ord(c) | 0xFF) + 1)) if unicodedata.category(x) == kind)


@lru_cache(maxsize=32)
def days(day_digits: int, month_digits: int, least_day: int = 1) -> list[int]:
    """The days, counted from FIRST_DAY, that can be written with so many digits for day and month."""
    fits = lambda d: (day_digits == 2 or d.day < 10) and (month_digits == 2 or d.month < 10) and d.day >= least_day
    return [i for i in range(DAYS) if fits(datetime.date.fromordinal(FIRST_DAY + i))]


def mod_97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


class Pseudonyms:
    """Replacements by kind; each is None if the value isn't valid. by: -1 turns pseudonyms back."""

    def __init__(self, key: bytes, by: int = 1) -> None:
        self.key, self.by, self.made = key, by, {}

    def _moved(self, tag: str, place: int, size: int) -> int:
        if (tag, size) not in self.made:
            self.made[tag, size] = Permutation(self.key, tag, size)
        return self.made[tag, size].pseudonym(place, self.by)

    def letters(self, tag: str, text: str, alphabets: list[str] | None = None) -> str:
        """text with each letter replaced within its alphabet, all as one number; what is in none stays."""
        own = [next((a for a in alphabets if c in a), "") if alphabets else alphabet(c) for c in text]
        place, size = 0, 1
        for c, a in zip(text, own):
            if a:
                place, size = place * len(a) + a.index(c), size * len(a)
        if size < 2:
            return text
        shape = "".join({LOWER: "0", UPPER: "1", DIGIT: "2", HEX: "0", HEX.upper(): "1"}.get(a, a[0]) if a else c for c, a in zip(text, own))
        place, out = self._moved(f"{tag}:{shape}", place, size), []
        for c, a in zip(reversed(text), reversed(own)):
            if a:
                place, i = divmod(place, len(a))
                c = a[i]
            out.append(c)
        return "".join(reversed(out))

    @staticmethod
    def _filled(shape: str, digits: str) -> str:
        """shape with its digits, from the left, replaced."""
        rest = iter(digits)
        return "".join(next(rest) if c in DIGIT else c for c in shape)

    def card(self, m: re.Match) -> str | None:
        digits = re.sub("[^0-9]", "", m[0])
        if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]) or not digits.strip("0"):
            return None
        n = len(digits) - 2
        new = digits[0] + str(self._moved(f"card:{digits[0]}", int(digits[1:-1]), 10**n)).zfill(n)
        return self._filled(m[0], new + str(luhn(new)))

    def iban(self, m: re.Match) -> str | None:
        flat = m[0].replace(" ", "")
        if not 15 <= len(flat) <= 34 or mod_97(flat[4:] + flat[:4]) != 1:
            return None
        body = self.letters(f"iban:{flat[:2]}", flat[4:])
        new = iter(f"{flat[:2]}{98 - mod_97(body + flat[:2] + '00'):02d}{body}")
        return "".join(c if c == " " else next(new) for c in m[0])

    def ssn(self, m: re.Match) -> str | None:
        area, group, serial = map(int, m[0].split("-"))
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        place = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        place, serial = divmod(self._moved("ssn", place, 898 * 99 * 9999), 9999)
        area, group = divmod(place, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def ip(self, m: re.Match) -> str | None:
        octets = m[0].split(".")
        if any(int(x) > 255 or x != str(int(x)) for x in octets):
            return None
        place = self._moved("ip", int.from_bytes(bytes(map(int, octets))), 1 << 32)
        return ".".join(map(str, place.to_bytes(4)))

    def ip6(self, m: re.Match) -> str | None:
        digits = m[0].replace(":", "")
        try:
            ipaddress.IPv6Address(m[0])
        except ValueError:
            return None
        if len(digits) < 4 or not any(c in DIGIT for c in digits):
            return None
        kinds = [HEX] if digits == digits.lower() else [HEX.upper()] if digits == digits.upper() else [DIGIT, HEX[10:], HEX[10:].upper()]
        return self.letters("ip6", m[0], kinds)

    def date(self, m: re.Match) -> str | None:
        sep = m["a"] or m["b"]
        parts = m[0].split(sep)
        for order in ("ymd",) if m["a"] else ("dmy",) if sep == "." else ("mdy", "dmy"):
            text = dict(zip(order, parts))
            try:
                place = datetime.date(*(int(text[k]) for k in "ymd")).toordinal() - FIRST_DAY
            except ValueError:
                continue
            # where both orders are in use, day first is told by a day over 12
            shape = (len(text["d"]), len(text["m"]), 13 if order == "dmy" and sep != "." else 1)
            among = days(*shape)
            at = bisect_left(among, place)
            if at == len(among) or among[at] != place:
                return None
            new = datetime.date.fromordinal(FIRST_DAY + among[self._moved(f"date:{shape}", at, len(among))])
            now = {"y": str(new.year), "m": str(new.month).zfill(shape[1]), "d": str(new.day).zfill(shape[0])}
            return sep.join(now[k] for k in order)
        return None

    def phone(self, m: re.Match) -> str | None:
        head = re.match(r"\+[0-9]{1,3}(?=[ .(-])|\+1|\+[0-9]{2}|", m[0])[0]
        rest = m[0][len(head) :]
        if not 8 <= sum(c in DIGIT for c in m[0]) <= 15:
            return None
        flat = re.sub("[^0-9]", "", rest)
        # a first digit of 0 or 1 stays one, others stay others: national numbers keep their sense
        kinds = ["01" if flat[0] in "01" else "23456789"] + [DIGIT] * (len(flat) - 1)
        place, size = 0, 1
        for c, a in zip(flat, kinds):
            place, size = place * len(a) + a.index(c), size * len(a)
        place, out = self._moved(f"phone:{head}:{kinds[0]}:{len(flat)}", place, size), []
        for a in reversed(kinds):
            place, i = divmod(place, len(a))
            out.append(a[i])
        return head + self._filled(rest, "".join(reversed(out)))

    def email(self, m: re.Match) -> str | None:
        local, domain = m["local"], m[0][len(m["local"]) :]
        new = self.letters(f"email:{domain.lower()}", local)
        return None if new == local else new + domain

    def secret(self, m: re.Match) -> str | None:
        if m["access"]:
            return m["access"][:4] + self.letters("access", m["access"][4:])
        code = m["known"] or m["code"]
        kinds = [HEX] if set(code) <= set(HEX) else None
        if len(code) <= BLOCK:
            return m[0][: -len(code)] + self.letters("secret", code, kinds)
        # blocks of equal size, each under a tag of all that stands before it in the clear code, so they turn back in order
        n = -(-len(code) // BLOCK)
        ends = [len(code) * i // n for i in range(n + 1)]
        new, seen = "", hashlib.blake2b(key=self.key[:64], digest_size=16)
        for lo, hi in zip(ends, ends[1:]):
            block, tag = code[lo:hi], f"secret:{len(code)}:{lo}:{seen.hexdigest()}"
            moved = self.letters(tag, block, kinds)
            self.made.clear()  # such a tag doesn't come again
            seen.update((block if self.by > 0 else moved).encode())
            new += moved
        return m[0][: -len(code)] + new


KINDS = ("secret", "email", "iban", "ip", "ip6", "date", "ssn", "phone", "card")


def replace(text: str, using: Pseudonyms) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, begin, length) of each value in the original text."""
    if not HINT.search(text):
        return text, []
    found: list[tuple[str, int, int]] = []
    act: dict[str, Callable[[re.Match], str | None]] = {k: getattr(using, k) for k in KINDS}
    out, at, seek = [], 0, 0
    while m := VALUE.search(text, seek):
        kind = next(k for k in KINDS if m[k] is not None)
        new = act[kind](m)
        if new is None and kind in ("phone", "date", "ip", "ip6", "iban", "ssn", "card"):
            seek = m.start() + 1  # another kind may begin inside
            continue
        seek = m.end()
        if new is not None:
            out += [text[at : m.start()], new]
            at = m.end()
            found.append(("ip" if kind == "ip6" else kind, m.start(), m.end() - m.start()))
    return ("".join([*out, text[at:]]), found) if found else (text, found)


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with pseudonyms and spans (kind, begin and length of each value in the given text). A map over rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using = Pseudonyms(key)
        for batch in batches:
            for lo, hi in C.chunks(C.text_bytes(batch.column(1))[1], 8_000_000):
                done = [(None, []) if x is None else replace(x, using) for x in batch.column(1).slice(lo, hi - lo).to_pylist()]
                spans = [[{"kind": k, "begin": b, "length": n} for k, b, n in x] for _, x in done]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("length", pa.int32())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([x for x, _ in done], pa.string()), pa.array(spans, kind)], names=["doc_id", "text", "spans"])

    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    return rows.mapInArrow(run, "doc_id long, text string, spans array<struct<kind string, begin int, length int>>")


def key_of(spark: SparkSession) -> bytes:
    """The setting spark.strandlog.pseudonym.key; without it a random key, made once and kept in the shared folder."""
    told = spark.conf.get("spark.strandlog.pseudonym.key", None)
    return told.encode() if told else C.kept_secret(spark, "pseudonym.key")


def op5_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymise(C.load(spark, sf_dir, "documents"), key_of(spark))
    return found.selectExpr("doc_id", "text", "cast(size(spans) as bigint) as n_replaced", "array_sort(array_distinct(spans.kind)) as kinds")
