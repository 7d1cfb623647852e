"""Format-preserving pseudonyms for personal data.

Card numbers, bank accounts, telephone and social security numbers, network addresses, dates, mail addresses and secrets
are found by pattern, validated (checksums, ranges, the calendar), and replaced inside their format: the value becomes a
number of the format's domain, a keyed Feistel network permutes that domain, and the result is written back with the
separators that were there. Equal values therefore get equal pseudonyms in all documents (whatever their separators; a day in
any of its notations; a North American number with or without its country code), no two values share one, a card number stays a
valid card number and a date a date, and who has the key can turn it back. Country codes, domains, the kinds of a secret's
characters, and whether a day is beyond the 12th stay as they are: the last keeps ``25/12/1999`` readable day first only. A secret is
all that follows its name up to white space, or up to the closing mark of quotation; its letters and digits are permuted, other marks stay.

A Feistel network permutes a rectangle a x b that holds the domain; results outside the domain are permuted again (cycle
walking), which keeps it a permutation.

What fails its validation is left alone. Bounds: days are those of 1900 to 2099, in numbers or with English names of months; mail names
may have Latin, Greek and Cyrillic letters; telephone numbers without a country code are North American, and where only spaces part
them they must be valid ones. Restoring gives the same value; a day that was written with single digits or a month's name, and a network
address, may come back in another spelling of it.

Defined results: null text stays null, empty text empty; repeated rows get the same text each; an empty table gives an
empty result; all other columns are carried as they are, except that the two added ones replace any of the same name. A text is
searched whole, whatever its length, in time linear in it.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from athenaeum.llm.common import sized_slices

ROUNDS = 10


class Feistel:
    """Keyed permutations of ranges of whole numbers."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key).digest()[:32]

    def _round(self, tweak: bytes, i: int, value: int, modulus: int) -> int:
        data = b"%s|%d|%x|%x" % (tweak, i, modulus, value)
        return int.from_bytes(hashlib.blake2b(data, key=self.key).digest(), "big") % modulus

    def _once(self, n: int, a: int, b: int, tweak: bytes) -> int:
        left, right = n % a, n // a
        for i in range(ROUNDS):
            # the halves change roles: each is shifted by a function of the other, within its own range
            if i % 2:
                right = (right + self._round(tweak, i, left, b)) % b
            else:
                left = (left + self._round(tweak, i, right, a)) % a
        return left + a * right

    def _back(self, n: int, a: int, b: int, tweak: bytes) -> int:
        left, right = n % a, n // a
        for i in reversed(range(ROUNDS)):
            if i % 2:
                right = (right - self._round(tweak, i, left, b)) % b
            else:
                left = (left - self._round(tweak, i, right, a)) % a
        return left + a * right

    def _walk(self, step: Callable, n: int, size: int, tweak: bytes) -> int:
        a = math.isqrt(size - 1) + 1
        b = -(-size // a)
        while (n := step(n, a, b, tweak)) >= size:
            pass
        return n

    def permute(self, n: int, size: int, tweak: bytes) -> int:
        return self._walk(self._once, n, size, tweak) if size > 1 else n

    def restore(self, n: int, size: int, tweak: bytes) -> int:
        return self._walk(self._back, n, size, tweak) if size > 1 else n


def luhn(digits: str) -> int:
    """The sum that a valid number has as a multiple of ten."""
    return sum(d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(map(int, reversed(digits)))) % 10


def mod97(account: str) -> int:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


#: The kinds of characters that keep their kind.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
HEX = "0123456789abcdef"
#: Months, and what a word of a mail's name is made of.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
NAME = "A-Za-z0-9_\u00C0-\u024F\u0300-\u036F\u0370-\u052F"
#: Days of 1900 to 2099 up to the 12th of a month, and those beyond: each permutes among itself, see :meth:`Pseudonyms.date`.
EARLY, LATE = ([n for n in range(datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal()) if (datetime.date.fromordinal(n).day > 12) is late] for late in (False, True))
PLACE = {n: i for days in (EARLY, LATE) for i, n in enumerate(days)}
#: Country calling codes of one and of two digits; all others have three.
SHORT_CODES = {"1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98"}
#: Characters of a secret that are permuted together.
RUN = 128


@lru_cache(maxsize=4096)
def alphabet(c: str, alphabets: tuple[str, ...] = ALPHABETS) -> str | None:
    """The characters that ``c`` may become: those of its kind. Letters beyond ASCII become letters of their block and case."""
    for a in alphabets:
        if c in a:
            return a
    kind = unicodedata.category(c)
    if c < "\x80" or kind[0] not in "LN":
        return None
    start = ord(c) & ~0xFF
    return "".join(x for x in map(chr, range(max(start, 0x80), start + 256)) if unicodedata.category(x) == kind)


class Pseudonyms:
    """Finds and replaces; ``unmask`` runs the permutation backwards."""

    def __init__(self, key: bytes, unmask: bool = False) -> None:
        feistel = Feistel(key)
        self.move = feistel.restore if unmask else feistel.permute

    def _symbols(self, text: str, tweak: bytes, alphabets: tuple[str, ...] = ALPHABETS) -> str:
        """Every character becomes one of its own alphabet; others stay."""
        sets = [alphabet(c, alphabets) for c in text]
        value, size = 0, 1
        for c, a in zip(text, sets, strict=True):
            if a:
                value, size = value * len(a) + a.index(c), size * len(a)
        value, out = self.move(value, size, tweak + b"".join(b"%x" % (len(a) if a else 0) for a in sets)), []
        for c, a in zip(reversed(text), reversed(sets), strict=True):
            out.append(a[value % len(a)] if a else c)
            value //= len(a) if a else 1
        return "".join(reversed(out))

    @staticmethod
    def _refill(shape: str, digits: str) -> str:
        """``digits`` in the places of the shape's digits."""
        it = iter(digits)
        return "".join(next(it) if c.isdigit() else c for c in shape)

    def card(self, m: re.Match) -> str | None:
        digits = re.sub(r"\D", "", m[0])
        if luhn(digits) or digits[0] == "0" or len(set(digits)) == 1:
            return None
        n = len(digits) - 2
        middle = f"{self.move(int(digits[1:-1]), 10**n, b'card%d' % n):0{n}d}"
        body = digits[0] + middle
        return self._refill(m[0], body + str(-luhn(body + "0") % 10))

    def phone(self, m: re.Match) -> str | None:
        digits = re.sub(r"\D", "", m[0])
        if not 7 <= len(digits) <= 15:
            return None
        if re.fullmatch(r"\d{3} \d{3} \d{4}", m[0]) and (digits[0] in "01" or digits[3] in "01"):
            return None  # three numbers rather than a telephone's
        # what follows a plus sign begins with a country code, which stays; without one the number is North American
        code = (next((n for n in (1, 2) if digits[:n] in SHORT_CODES), 3)) if "+" in m[0] else 0
        head, national = digits[:code], digits[code:]
        if head in ("", "1") and len(national) == 10 and national[0] in "23456789" and national[3] in "23456789":
            area, exchange, line = int(national[:3]) - 200, int(national[3:6]) - 200, int(national[6:])
            n = self.move((area * 800 + exchange) * 10_000 + line, 800 * 800 * 10_000, b"phone")
            out = f"{n // 8_000_000 + 200}{n // 10_000 % 800 + 200}{n % 10_000:04d}"
        else:
            size = len(national)
            out = f"{self.move(int(national), 10**size, b'phone%d %s' % (size, head.encode())):0{size}d}"
        return self._refill(m[0], head + out)

    def ssn(self, m: re.Match) -> str | None:
        area, group, serial = map(int, m[0].split("-"))
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        place = area - 1 - (area > 666)
        n = self.move((place * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, b"ssn")
        area = n // (99 * 9999) + 1
        return f"{area + (area >= 666):03d}-{n // 9999 % 99 + 1:02d}-{n % 9999 + 1:04d}"

    def address(self, m: re.Match) -> str | None:
        parts = m[0].split(".")
        if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
            return None
        n = self.move(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, b"ipv4")
        return ".".join(map(str, n.to_bytes(4, "big")))

    def date(self, m: re.Match) -> str | None:
        """A day of another month and year. With slashes the month comes first unless only the other order is a date, which

        takes a day beyond the 12th; those permute among themselves, so that a day-first date stays one in all notations.
        """
        a, mark, b, _, c = re.split(r"([-/.])", m[0])
        plain = len(a) == 1 or len(b) == 1  # written without leading zeros
        for year, month, day in [(a, b, c)] if len(a) == 4 else [(c, a, b), (c, b, a)] if mark == "/" else [(c, b, a)]:
            d = self._day(int(year), int(month), int(day))
            if d is None:
                continue
            width = 1 if plain else 2
            made = {id(year): f"{d.year:04d}", id(month): f"{d.month:0{width}d}", id(day): f"{d.day:0{width}d}"}
            return mark.join(made[id(x)] for x in (a, b, c))
        return None

    def _day(self, year: int, month: int, day: int) -> datetime.date | None:
        """The day that this one becomes; None if it is none."""
        try:
            n = datetime.date(year, month, day).toordinal()
        except ValueError:
            return None
        if n not in PLACE:
            return None
        days, tweak = (LATE, b"late") if day > 12 else (EARLY, b"early")
        return datetime.date.fromordinal(days[self.move(PLACE[n], len(days), tweak)])

    def named_date(self, m: re.Match) -> str | None:
        """A day with its month's name, in full or by three letters."""
        name = m["m1"] or m["m2"]
        month = next(i for i, full in enumerate(MONTHS, 1) if full[:3].lower() == name[:3].lower())
        if len(name) > 3 and name.lower() != MONTHS[month - 1].lower():
            return None
        d = self._day(int(m["y1"] or m["y2"]), month, int(m["d1"] or m["d2"]))
        if d is None:
            return None
        made = MONTHS[d.month - 1] if len(name) > 3 else MONTHS[d.month - 1][:3]
        made = made.upper() if name.isupper() else made.lower() if name.islower() else made
        new = {"m1": made, "m2": made, "d1": str(d.day), "d2": str(d.day), "y1": f"{d.year:04d}", "y2": f"{d.year:04d}"}
        out, at = [], m.start()
        for group in sorted((g for g in new if m[g] is not None), key=m.start):
            out += [m.string[at : m.start(group)], new[group]]
            at = m.end(group)
        return "".join([*out, m.string[at : m.end()]])

    def address6(self, m: re.Match) -> str | None:
        try:
            value = ipaddress.IPv6Address(m[0])
        except ValueError:
            return None
        if len(m[0].replace(":", "")) < 5:
            return None  # what has few digits is rather a path of names
        return str(ipaddress.IPv6Address(self.move(int(value), 1 << 128, b"ipv6")))

    def account(self, m: re.Match) -> str | None:
        text = m[0].replace(" ", "").upper()
        if not 15 <= len(text) <= 34 or mod97(text) != 1:
            return None
        body = self._symbols(text[4:], b"iban" + text[:2].encode())
        check = 98 - mod97(text[:2] + "00" + body)
        made = f"{text[:2]}{check:02d}{body}"
        it = iter(made.lower() if m[0].islower() else made)
        return "".join(c if c == " " else next(it) for c in m[0])

    def mail(self, m: re.Match) -> str:
        local, _, domain = m[0].partition("@")
        return f"{self._symbols(local, b'mail' + domain.lower().encode())}@{domain}"

    def key(self, m: re.Match) -> str:
        return m[0][:4] + self._symbols(m[0][4:], b"key", ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",))

    def secret(self, m: re.Match) -> str:
        group = next(g for g in ("double", "single", "plain") if m[g] is not None)
        value, start = m[group], m.start(group)
        if group == "plain":
            value = value.rstrip(".,;:!?)]}>") or value  # the sentence's own marks stay and don't change what it becomes
        end = start + len(value)
        # a key or an address keeps its link with where it stands alone
        for kind in ("key", "mail"):
            if whole := BY_KIND[kind].fullmatch(value):
                return m.string[m.start() : start] + getattr(self, kind)(whole) + m.string[end : m.end()]
        alphabets = (HEX,) if re.fullmatch("[0-9a-f]+", value) else ALPHABETS
        # a long one is permuted run by run, for the numbers of whole ones would take time quadratic in their length
        made = [self._symbols(value[i : i + RUN], b"secret%d" % i if i else b"secret", alphabets) for i in range(0, len(value), RUN)]
        return m.string[m.start() : start] + "".join(made) + m.string[end : m.end()]

    def replace(self, text: str) -> tuple[str, list[tuple[int, int, str]]]:
        """The text with pseudonyms, and (start, end, kind) of each in the given text."""
        found: list[tuple[int, int, str, str]] = []
        for kind, sign, pattern in PATTERNS:
            if not (sign.search(text) if isinstance(sign, re.Pattern) else sign in text):
                continue
            at, new = 0, []
            for m in pattern.finditer(text):
                # matches and what is found so far both run in order of their places
                while at < len(found) and found[at][1] <= m.start():
                    at += 1
                if at < len(found) and found[at][0] < m.end():
                    continue
                made = getattr(self, kind)(m)
                if made is not None:
                    new.append((m.start(), m.end(), kind, made))
            found = sorted(found + new)
        if not found:
            return text, []
        out, at = [], 0
        for a, b, _, made in found:
            out += [text[at:a], made]
            at = b
        return "".join([*out, text[at:]]), [x[:3] for x in found]


_DIGITS, _DIGIT, _DOTTED, _HEXES = re.compile(r"\d{2}"), re.compile(r"\d"), re.compile(r"\d\.\d"), re.compile(r"[0-9A-Fa-f]:[0-9A-Fa-f:]")
_MONTH = "|".join(f"{full[:3]}(?:{full[3:]})?" if full[3:] else full for full in MONTHS)
#: In order of precedence: kind, what a text must hold for the pattern to be tried, pattern. Quantifiers are bounded, but for a secret's, which nothing follows.
PATTERNS = (
    ("secret", re.compile(r"[=:]"), re.compile(r"""(?i:(?<![A-Za-z])(?:password|passwd|pwd|token|secret|api[_-]?key))["']?\s{0,3}[=:]\s{0,3}(?:"(?P<double>[^"\n]{6,256})(?=")|'(?P<single>[^'\n]{6,256})(?=')|["']?(?P<plain>[^\s"']{6,}))""")),
    ("mail", "@", re.compile(rf"(?<![{NAME}.%+-])[{NAME}.%+-]{{1,64}}@(?:[{NAME}-]{{1,63}}\.){{1,8}}[A-Za-z\u00C0-\u024F\u0370-\u052F]{{2,24}}")),
    ("key", "AKIA", re.compile(r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])")),
    ("account", _DIGITS, re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("card", _DIGIT, re.compile(r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])")),
    ("ssn", _DIGITS, re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("date", _DIGITS, re.compile(r"(?<![\w.-])(?:\d{4}([-/.])\d{2}\1\d{2}(?:(?=T\d{2})|(?![\w-]))|\d{1,2}([-/.])\d{1,2}\2\d{4}(?![\w-]))")),
    ("named_date", re.compile("[12]\\d{3}"), re.compile(rf"(?i)(?<!\w)(?:(?P<d1>\d{{1,2}})(?:st|nd|rd|th)?[ \u00a0](?P<m1>{_MONTH})\.?,?[ \u00a0](?P<y1>\d{{4}})|(?P<m2>{_MONTH})\.?[ \u00a0](?P<d2>\d{{1,2}})(?:st|nd|rd|th)?,?[ \u00a0](?P<y2>\d{{4}}))(?!\w)")),
    ("address", _DOTTED, re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)")),
    ("address6", _HEXES, re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")),
    ("phone", _DIGITS, re.compile(r"(?<![\w+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\w)|(?<![\w+])\+\d(?:\)?[ .-]?\(?\d){6,14}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])(?<!\d )\d{3}([ .-])\d{3}\1\d{4}(?![\w-]| \d)")),
)
BY_KIND = {kind: pattern for kind, _, pattern in PATTERNS}


def pseudonymize(docs: DataFrame, key: bytes, unmask: bool = False) -> DataFrame:
    """``docs`` with its text's personal data replaced; adds pii_count and pii_spans (start, end, kind in the old text)."""
    carried = [f.name for f in docs.schema if f.name not in ("pii_count", "pii_spans")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key, unmask)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for batch in batches:
            for part in sized_slices(batch, "text"):
                made = [names.replace(t) if t else (t, []) for t in part.column("text").to_pylist()]
                spans = pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in s] for _, s in made], kind)
                columns = [pa.array([t for t, _ in made], part.schema.field("text").type) if n == "text" else part.column(n) for n in carried]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([len(s) for _, s in made], pa.int32()), spans], names=[*carried, "pii_count", "pii_spans"])

    source = docs.select(*[F.col(f"`{c}`") for c in carried])
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())])
    return source.mapInArrow(run, T.StructType([*source.schema, T.StructField("pii_count", T.IntegerType()), T.StructField("pii_spans", T.ArrayType(span))]))
