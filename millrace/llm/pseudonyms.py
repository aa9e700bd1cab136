"""PII: format-preserving Feistel pseudonyms for validated numbers and dates."""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
#: IBAN lengths by country (ISO 13616 registry).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22,
    "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27,
    "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33,
    "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29,
    "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
#: Country calling codes of one and of two digits (ITU E.164); all others have three.
CALLING_CODES = (
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
).split()


class Permutation:
    """A keyed permutation of 0 … size - 1: a balanced Feistel network over enough bits, walked along its cycle back into the range."""

    def __init__(self, key: bytes, kind: str, size: int):
        self.size, self.half = size, max(1, ((size - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.base = hashlib.blake2b(key=key[:64], digest_size=16, person=kind.encode()[:16])

    def _round(self, i: int, x: int) -> int:
        h = self.base.copy()
        h.update(i.to_bytes(1, "big") + x.to_bytes(16, "big"))
        return int.from_bytes(h.digest(), "big") & self.mask

    def _pass(self, x: int, rounds) -> int:
        a, b = x >> self.half, x & self.mask
        for i in rounds:
            a, b = b, a ^ self._round(i, b)
        return b << self.half | a

    def forward(self, x: int) -> int:
        while True:
            x = self._pass(x, range(ROUNDS))
            if x < self.size:
                return x

    def backward(self, x: int) -> int:
        while True:
            x = self._pass(x, range(ROUNDS - 1, -1, -1))
            if x < self.size:
                return x


def luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = sum(d if i % 2 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def iban_check(country: str, account: str) -> str:
    """The two check digits of an IBAN (ISO 7064, modulo 97)."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


def _refill(shape: str, digits: str) -> str:
    """``digits`` in the places of the digits of ``shape``."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


#: A kind has a pattern, and a function from a match to (kind and size of its domain, number, function from a number to text), or None if the match isn't valid.
Parsed = tuple[str, int, int, Callable[[int], str]]


def _card(m: re.Match) -> Parsed | None:
    digits = re.sub(r"\D", "", m[0])
    if not 13 <= len(digits) <= 19 or len(set(digits)) == 1 or luhn(digits[:-1]) != int(digits[-1]):
        return None
    n = len(digits) - 1

    def text(x: int) -> str:
        body = f"{x:0{n}d}"
        return _refill(m[0], body + str(luhn(body)))

    return f"card{n}", 10**n, int(digits[:-1]), text


def _iban(m: re.Match) -> Parsed | None:
    flat = m[0].replace(" ", "")
    country, account = flat[:2], flat[4:]
    if IBAN_LENGTHS.get(country) != len(flat) or iban_check(country, account) != flat[2:4]:
        return None
    digits = re.sub(r"\D", "", account)
    if not digits:
        return None

    def text(x: int) -> str:
        new = _refill(account, f"{x:0{len(digits)}d}")
        it = iter(country + iban_check(country, new) + new)
        return "".join(c if c == " " else next(it) for c in m[0])

    letters = re.sub(r"\d", "0", account)
    return f"iban{country}{letters}", 10 ** len(digits), int(digits), text


def _phone(m: re.Match) -> Parsed | None:
    digits = re.sub(r"\D", "", m[0])
    return "phone", 10**10, int(digits), lambda x: _refill(m[0], f"{x:010d}")


def _abroad(m: re.Match) -> Parsed | None:
    """A number with a country code, which stays; ten digits after +1 link with the number written without it."""
    digits = re.sub(r"\D", "", m[0])
    code = next((digits[:n] for n in (1, 2) if digits[:n] in CALLING_CODES), digits[:3])
    n = len(digits) - len(code)
    if digits[0] == "0" or not 7 <= n <= 15 - len(code) or (code == "1" and n != 10):
        return None
    kind = "phone" if code == "1" else f"phone{code}-{n}"
    return kind, 10**n, int(digits[len(code) :]), lambda x: _refill(m[0], f"{code}{x:0{n}d}")


def _ssn(m: re.Match) -> Parsed | None:
    area, group, serial = map(int, (m[1], m[2], m[3]))
    if not 0 < area < 900 or area == 666 or not group or not serial:
        return None
    areas = area - 1 - (area > 666)

    def text(x: int) -> str:
        x, s = divmod(x, 9999)
        a, g = divmod(x, 99)
        a += 1 + (a + 1 >= 666)
        return f"{a:03d}-{g + 1:02d}-{s + 1:04d}"

    return "ssn", 898 * 99 * 9999, (areas * 99 + group - 1) * 9999 + serial - 1, text


def _ipv4(m: re.Match) -> Parsed | None:
    parts = m[0].split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = int.from_bytes(bytes(map(int, parts)), "big")
    return "ipv4", 1 << 32, x, lambda y: ".".join(map(str, y.to_bytes(4, "big")))


@functools.cache
def _days(late: bool | None, widths: tuple[int, int] | None) -> list[int]:
    """The ordinals of the days that are (not) after the 12th of their month and whose day and month have so many digits."""
    days = map(datetime.date.fromordinal, range(FIRST_DAY, LAST_DAY + 1))
    return [d.toordinal() for d in days if late in (None, d.day > 12) and widths in (None, (len(str(d.day)), len(str(d.month))))]


def _date(*orders: str, sep: int):
    """Orders are tried in turn; dates by the later ones must not read as dates by the first.

    Days up to the 12th are permuted among themselves, and so are later ones: so a date that can only be read
    month first gives another such, and dates link across formats. Where the day or the month has
    no leading zero, only days of as many digits are exchanged, which link with their like alone.
    """

    def parse(m: re.Match) -> Parsed | None:
        parts = [m[i] for i in range(1, 5) if i != sep]
        for order in orders:
            got = dict(zip(order, parts, strict=True))
            try:
                date = datetime.date(*(int(got[k]) for k in "ymd"))
            except ValueError:
                continue
            day, widths = date.toordinal(), (len(got["d"]), len(got["m"]))
            if not FIRST_DAY <= day <= LAST_DAY:
                return None
            plain = widths == (2, 2)
            if not plain and any(got[k].startswith("0") for k in "dm"):
                return None
            late = date.day > 12 if plain or order == "mdy" else None
            days = _days(late, None if plain else widths)

            def text(x: int, days=days, order=order, plain=plain) -> str:
                d = datetime.date.fromordinal(days[x])
                new = {"y": f"{d.year:04d}", "m": f"{d.month:02d}" if plain else str(d.month), "d": f"{d.day:02d}" if plain else str(d.day)}
                return m[sep].join(new[k] for k in order)

            kind = f"date{late}" if plain else f"date{order}{widths}{late}"
            return kind, len(days), bisect.bisect_left(days, day), text
        return None

    return parse


def _iban_pattern(country: str, length: int) -> str:
    """Groups of four, parted by a space or not, to the length of the country."""
    fours, rest = divmod(length - 4, 4)
    return rf"{country}\d\d(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (rf" ?[A-Z0-9]{{{rest}}}" if rest else "")


#: Kinds in the order in which they are tried at a place. Dates with slashes are day, month, year, or month, day, year if only that is a date; those with dots the former.
KINDS: dict[str, tuple[str, Callable[[re.Match], Parsed | None]]] = {
    "iban": (f"(?:{'|'.join(_iban_pattern(*x) for x in IBAN_LENGTHS.items())})(?![A-Z0-9])", _iban),
    "ssn": (r"(\d{3})-(\d{2})-(\d{4})(?![-\d])", _ssn),
    "iso_date": (r"(\d{4})(-)(\d{2})-(\d{2})(?![-\d])", _date("ymd", sep=2)),
    "date": (r"(\d{1,2})(/)(\d{1,2})/(\d{4})(?!\d)", _date("dmy", "mdy", sep=2)),
    "dotted_date": (r"(\d{1,2})(\.)(\d{1,2})\.(\d{4})(?!\d)", _date("dmy", sep=2)),
    "ipv4": (r"\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", _ipv4),
    "abroad": (r"\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{1,4}){2,6}(?!\d)", _abroad),
    "phone": (r"(?:\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4})(?![-\d])", _phone),
    "card": (r"(?:\d[ -]?){12,18}\d(?!\d)", _card),
}
#: On a failed check the shorter ends of cards and of numbers with a country code are tried too, the longest first.
_SHORTER = {
    "card": [re.compile(rf"(?:\d[ -]?){{{n}}}\d(?!\d)") for n in range(17, 11, -1)],
    "abroad": [re.compile(rf"\+(?:[ .-]?\(?\d\)?){{{n}}}(?!\d)") for n in range(15, 7, -1)],
}
#: A value may follow anything but a letter or digit, or a digit with a dot or dash.
_STARTS = re.compile(r"(?<!\w)(?<!\d[.-])(?=[A-Z]{2}\d{2}|\d|\(\d|\+\d)")
_HAS = re.compile(r"\d")
_PATTERNS = [(k, re.compile(p), f) for k, (p, f) in KINDS.items()]


PII_TYPE = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in ("start", "end", "new_start", "new_end"))])
)


class Pseudonymiser:
    """Replaces validated numbers and dates of a text, or restores them."""

    def __init__(self, key: bytes, kinds: list[str] | None = None):
        if not key:
            raise ValueError("a key is needed")
        self.key, self.made = key, {}
        self.patterns = [x for x in _PATTERNS if kinds is None or x[0] in kinds]

    def _value(self, kind: str, size: int, x: int, back: bool) -> int:
        p = self.made.get(kind)
        if p is None:
            p = self.made[kind] = Permutation(self.key, hashlib.blake2b(kind.encode(), digest_size=8).hexdigest(), size)
        return p.backward(x) if back else p.forward(x)

    def apply(self, text: str, back: bool = False) -> tuple[str, list[tuple[str, int, int, int, int]]]:
        """The new text and its replacements: kind, start and end in the old text, start and end in the new."""
        if not _HAS.search(text):
            return text, []
        out, spans, at, made = [], [], 0, 0
        for start in _STARTS.finditer(text):
            if start.start() < at:
                continue
            for kind, pattern, parse in self.patterns:
                m = pattern.match(text, start.start())
                got = m and parse(m)
                if m and not got:
                    for shorter in _SHORTER.get(kind, ()):
                        m = shorter.match(text, start.start())
                        got = m and parse(m)
                        if got:
                            break
                if got:
                    domain, size, x, write = got
                    new = write(self._value(domain, size, x, back))
                    out += [text[at : m.start()], new]
                    made += m.start() - at + len(new)
                    spans.append((kind, m.start(), m.end(), made - len(new), made))
                    at = m.end()
                    break
        return "".join([*out, text[at:]]), spans


def pseudonymise(docs: DataFrame, key: bytes, kinds: list[str] | None = None, back: bool = False) -> DataFrame:
    """``docs`` with its ``text`` replaced and ``pii`` added: an array of kind, ``start``, ``end``, ``new_start``, ``new_end``.

    Cards (Luhn), IBANs (modulo 97), US social security numbers, phone numbers (US, and any with a country code), IPv4
    addresses and calendar dates from 1900 to 2099 that pass their checks are
    permuted within their format by a Feistel network keyed with ``key``: the new
    value passes the same checks and keeps its separators. The permutation is of
    the number, so equal values get equal pseudonyms in all documents, and unlike
    ones unlike. ``back`` undoes it for anyone with the key: a new value is found where
    the old one was, unless the text around it happens to read on: a card followed by more
    digits after a separator, of up to 19 in all, is read with them if that passes the check (one time in ten).

    Numbers that fail their check stay. Nulls stay null with an empty ``pii``, repeated rows get equal texts;
    other columns pass unchanged, but one named ``pii`` is replaced. One pass
    over whole texts, no shuffle.
    """
    rest = [c for c in docs.columns if c not in ("text", "pii")]
    schema = docs.select(*rest, "text").schema.add("pii", PII_TYPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pseudonymiser(key, kinds)
        kind = pa.list_(pa.struct([("kind", pa.string()), *((c, pa.int32()) for c in ("start", "end", "new_start", "new_end"))]))
        names = ("kind", "start", "end", "new_start", "new_end")
        for batch in batches:
            got = [p.apply(t, back) if (t := x.as_py()) is not None else (None, []) for x in batch.column("text")]
            spans = [[dict(zip(names, s, strict=True)) for s in g[1]] for g in got]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array([g[0] for g in got], pa.string()), pa.array(spans, kind)], [*rest, "text", "pii"])

    return docs.select(*rest, "text").mapInArrow(run, schema)


def _of(kinds: list[str]):
    return lambda p: p["kind"].isin(*kinds)


def op1_feistel(spark, sf_dir: str) -> DataFrame:
    """Every document's new text, how many values of each kind it had, and their places in it.

    The key here is fixed so that reruns agree; a deployment passes a secret one.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = pseudonymise(docs, b"millrace example key")
    count = [F.size(F.filter("pii", _of(some))).alias(f"n_{k}") for k, some in (
        ("card", ["card"]), ("iban", ["iban"]), ("phone", ["phone", "abroad"]), ("ssn", ["ssn"]), ("ipv4", ["ipv4"]), ("date", ["date", "dotted_date", "iso_date"]))]
    spans = F.array_join(F.transform("pii", lambda p: F.concat_ws(":", p["kind"], p["new_start"].cast("string"), p["new_end"].cast("string"))), ",")
    return out.select("doc_id", "text", *count, spans.alias("spans"))
