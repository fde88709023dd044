"""Format-preserving pseudonyms for personal numbers and dates.

A value found and validated is replaced by another of the same kind and format
by a keyed permutation, so equal values stay equal across documents and no two
values become one. The permutation is a Feistel network over the two halves of
a mixed radix; where only part of the range is valid, it is applied again until
the result is valid, which keeps it a permutation of the valid values.

    card    13 to 19 digits with a right Luhn sum; first digit and length stay
    iban    right mod-97 sum; country and letters stay
    ssn     ddd-dd-dddd with an assigned area, group and serial
    phone   +1 and ten digits, other + numbers, (ddd) ddd-dddd; country stays
    ip      four octets up to 255
    date    days of 1900 to 2099, year first or last
    email   letters and digits of the local part; the domain stays

All work is on UTF-8 bytes, where every pattern is ASCII.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stonefly.llm.common import slices

#: In the order in which one of two finds with the same place is taken.
KINDS = ("iban", "card", "ssn", "phone", "ip", "date", "email")
ROUNDS = 10
#: Stands in where the session sets no key in ``KEY_CONF``; whoever knows the key can invert the pseudonyms.
KEY, KEY_CONF = "stonefly", "spark.stonefly.pii.key"

_END = rb"(?![0-9A-Za-z_]|[-./:][0-9])"
_CARD = re.compile(rb"(?<![0-9A-Za-z_.+-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})" + _END)
_IBAN = re.compile(rb"(?<![0-9A-Za-z_])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z_])")
_SSN = re.compile(rb"(?<![0-9A-Za-z_.+-])[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END)
_PHONE = re.compile(
    rb"(?<![0-9A-Za-z_.+-])(?:\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+(?!1[ .(-]|1[0-9]{10})[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]{2,12}){1,5}|\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}|[0-9]{3}([-.])[0-9]{3}\1[0-9]{4})" + _END
)
_IP = re.compile(rb"(?<![0-9A-Za-z_.-])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z_]|[-.][0-9])")  # a port or prefix may follow
_DATE = re.compile(rb"(?<![0-9A-Za-z_./-])(?:([0-9]{4})([-/.])([0-9]{1,2})\2([0-9]{1,2})|([0-9]{1,2})([-/.])([0-9]{1,2})\6([0-9]{4}))(?![0-9A-SU-Za-z_]|[-/.][0-9])")
#: Patterns with the digits that a find has at least, in the order of ``KINDS``.
_NUMERIC = (("iban", _IBAN, 2), ("card", _CARD, 13), ("ssn", _SSN, 9), ("phone", _PHONE, 8), ("ip", _IP, 4), ("date", _DATE, 6))
_LOCAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_LOCAL_FIRST = re.compile(rb"[A-Za-z0-9]")
#: Characters of a local part that are permuted together; a longer one is taken in such pieces.
_TOGETHER = 64
_DOMAIN = re.compile(rb"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9_])")
_DAYS = (date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal())


class Permutation:
    """Keyed permutations of 0 .. n - 1, one for each name and n."""

    def __init__(self, key: str):
        self.key = hashlib.sha256(key.encode()).digest()

    def _step(self, name: str, n: int, x: int) -> int:
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        left, right = x // b, x % b
        for r in range(ROUNDS):
            if r % 2:
                right = (right + self._f(name, n, r, left)) % b
            else:
                left = (left + self._f(name, n, r, right)) % a
        return left * b + right

    def _f(self, name: str, n: int, r: int, half: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{name}:{n}:{r}:{half}".encode(), key=self.key, digest_size=40).digest())

    def __call__(self, name: str, n: int, x: int, valid: Callable[[int], bool] = lambda x: True) -> int:
        """``x`` must be valid; so is the result."""
        if n < 2:
            return x
        while True:
            x = self._step(name, n, x)
            if x < n and valid(x):
                return x


def luhn_ok(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == digits[-1]


def luhn_digit(body: str) -> str:
    total = sum((d := int(c) * (1 + i % 2)) - 9 * (d > 9) for i, c in enumerate(reversed(body), 1))
    return str(-total % 10)


def iban_ok(s: str) -> bool:
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in turn."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


class Pseudonyms:
    """For each kind: the replacement of a text found, or None if it isn't valid."""

    def __init__(self, key: str):
        self.permute = Permutation(key)
        self.memo: dict[tuple[str, bytes], bytes | None] = {}

    def __call__(self, kind: str, found: bytes) -> bytes | None:
        at = (kind, found)
        if at not in self.memo:
            if len(self.memo) >= 100_000:
                self.memo.clear()
            new = getattr(self, kind)(found.decode())
            self.memo[at] = None if new is None else new.encode()
        return self.memo[at]

    def card(self, s: str) -> str | None:
        d = _digits(s)
        if not luhn_ok(d) or len(set(d)) == 1 or len(d) == 13 and d[0] != "4":
            return None
        middle = len(d) - 2
        # one digit throughout is no card, before and after
        valid = lambda x: len(set((body := d[0] + str(x).zfill(middle)) + luhn_digit(body))) > 1
        body = d[0] + str(self.permute(f"card{len(d)}{d[0]}", 10**middle, int(d[1:-1]), valid)).zfill(middle)
        return _refill(s, body + luhn_digit(body))

    def iban(self, s: str) -> str | None:
        d = s.replace(" ", "")
        if not iban_ok(d):
            return None
        n = len(_digits(d[4:]))
        shape = "".join("0" if c.isdigit() else c for c in d[4:])
        account = _refill(shape, str(self.permute(f"iban{d[:2]}{shape}", 10**n, int(_digits(d[4:]) or 0))).zfill(n) if n else "")
        check = str(98 - int("".join(str(int(c, 36)) for c in account + d[:2] + "00")) % 97).zfill(2)
        chars = iter(d[:2] + check + account)
        return "".join(c if c == " " else next(chars) for c in s)

    @staticmethod
    def _ssn_ok(x: int) -> bool:
        area, group, serial = x // 10**6, x // 10**4 % 100, x % 10**4
        return 0 < area < 900 and area != 666 and group > 0 and serial > 0

    def ssn(self, s: str) -> str | None:
        x = int(_digits(s))
        return _refill(s, str(self.permute("ssn", 10**9, x, self._ssn_ok)).zfill(9)) if self._ssn_ok(x) else None

    @staticmethod
    def _nanp(x: int) -> bool:
        return x // 10**9 >= 2 and x // 10**6 % 10 >= 2 and x // 10**8 % 10 < 9

    def phone(self, s: str) -> str | None:
        d = _digits(s)
        if s[0] == "+" and not (s.startswith("+1") and len(d) == 11):
            if not 8 <= len(d) <= 15:
                return None
            # the country is the first group, or the first two digits where there are no groups
            country = min(len(re.match(r"\+([0-9]*)", s)[1]), 3) if re.search(r"[^+0-9]", s) else 2
            n = len(d) - country
            return _refill(s, d[:country] + str(self.permute(f"phone{d[:country]}", 10**n, int(d[country:]))).zfill(n))
        own = int(d[-10:])
        plan = self._nanp(own)  # numbers that the dialling plan knows stay such, others stay others
        new = str(self.permute(f"phone1{int(plan)}", 10**10, own, lambda x: self._nanp(x) == plan)).zfill(10)
        return _refill(s, d[:-10] + new)

    def ip(self, s: str) -> str | None:
        parts = s.split(".")
        if any(int(p) > 255 or p != str(int(p)) for p in parts):
            return None
        return ".".join(map(str, self.permute("ip", 2**32, int.from_bytes(bytes(map(int, parts)))).to_bytes(4)))

    def date(self, s: str) -> str | None:
        m = _DATE.fullmatch(s.encode())
        first = m[1] is not None
        sep = (m[2] or m[6]).decode()
        year, x, y = (m[1], m[3], m[4]) if first else (m[8], m[5], m[7])
        padded = len(x) == len(y) == 2
        # year last: the day is first unless only the other way is a day
        orders = ["md"] if first else ["dm", "md"]

        def show(day: date, order: str) -> str:
            two = [day.month, day.day] if order == "md" else [day.day, day.month]
            parts = [f"{p:02d}" if padded else str(p) for p in two]
            return sep.join([str(day.year), *parts] if first else [*parts, str(day.year)])

        def read(text: str) -> tuple[date, str] | None:
            p = text.split(sep)
            yy, a, b = (p[0], p[1], p[2]) if first else (p[2], p[0], p[1])
            for order in orders:
                try:
                    day = date(int(yy), *((int(a), int(b)) if order == "md" else (int(b), int(a))))
                except ValueError:
                    continue
                return (day, order) if _DAYS[0] <= day.toordinal() <= _DAYS[1] else None
            return None

        was = read(s)
        if was is None or show(*was) != s:
            return None
        day, order = was

        def same(n: int) -> bool:
            """Written in this format the day is read back as itself, with a part of one digit if there was one."""
            new = date.fromordinal(_DAYS[0] + n)
            return read(show(new, order)) == (new, order) and (padded or new.day < 10 or new.month < 10)

        # one permutation for all formats but those in which some days cannot be written
        kind = "date" if padded and order == orders[0] else f"date{order}{padded}"
        return show(date.fromordinal(_DAYS[0] + self.permute(kind, _DAYS[1] - _DAYS[0] + 1, day.toordinal() - _DAYS[0], same)), order)

    def email(self, s: str) -> str | None:
        local, _, domain = s.rpartition("@")
        pieces = [local[i : i + _TOGETHER] for i in range(0, len(local), _TOGETHER)]
        return "".join(self._local(p, f"{i or ''}", domain) for i, p in enumerate(pieces)) + f"@{domain}"

    def _local(self, local: str, place: str, domain: str) -> str:
        sizes = [10 if c.isdigit() else 26 if c.isalpha() else 1 for c in local]
        x = 0
        for c, n in zip(local, sizes, strict=True):
            x = x * n + (int(c) if n == 10 else ord(c.lower()) - 97 if n == 26 else 0)
        x = self.permute(f"email{place}{''.join('09' if n == 10 else 'a' if n == 26 else c for c, n in zip(local, sizes, strict=True))}@{domain.lower()}", math.prod(sizes), x)
        out = []
        for c, n in zip(reversed(local), reversed(sizes), strict=True):
            x, digit = divmod(x, n)
            new = str(digit) if n == 10 else chr(97 + digit) if n == 26 else c
            out.append(new.upper() if c.isupper() else new)
        return "".join(reversed(out))


def _local_start(b: bytes, at: int) -> int | None:
    """Where the local part that ends before ``at`` starts, however long it is."""
    low, step = at, 64
    while low:
        part = b[max(0, low - step) : low]
        run = len(part) - len(part.rstrip(_LOCAL))
        low, step = low - run, 2 * step
        if run < len(part):
            break
    first = _LOCAL_FIRST.search(b, low, at)
    return first.start() if first else None


def _valid(kind: str, pattern: re.Pattern, b: bytes, pseudonyms: Pseudonyms) -> Iterator[tuple[int, int, bytes]]:
    """Start, end and replacement of the valid values of one kind. An invalid match hides nothing that starts within it."""
    at = 0
    while m := pattern.search(b, at):
        start, end = m.span()
        new = pseudonyms(kind, m[0])
        if new is None and kind == "iban":  # words in capitals after it may look like more of it
            while new is None and (end := b.rfind(b" ", start, end)) >= 0:
                new = pseudonyms(kind, b[start:end])
        if new is not None:
            yield start, end, new
        at = start + 1 if new is None else end


def find(b: bytes, pseudonyms: Pseudonyms) -> list[tuple[int, int, str, bytes]]:
    """Places, kinds and replacements of the valid values of a text; the leftmost of overlapping ones, at one start the longest, counts."""
    found = []
    digits = len(b) - len(b.translate(None, b"0123456789"))
    for rank, (kind, pattern, least) in enumerate(_NUMERIC):
        if digits >= least:
            found += [(start, -end, rank, kind, new) for start, end, new in _valid(kind, pattern, b, pseudonyms)]
    at = b.find(b"@")
    while at >= 0:
        if (right := _DOMAIN.match(b, at + 1)) and (start := _local_start(b, at)) is not None:
            found.append((start, -right.end(), len(KINDS), "email", pseudonyms("email", b[start : right.end()])))
        at = b.find(b"@", at + 1)
    out, done = [], 0
    for start, end, _, kind, new in sorted(found):
        if start >= done:
            out.append((start, -end, kind, new))
            done = -end
    return out


def replace(b: bytes, found: list[tuple[int, int, str, bytes]]) -> bytes:
    parts, at = [], 0
    for start, end, _, new in found:
        parts += [b[at:start], new]
        at = end
    return b"".join(parts) + b[at:]


def _spans(b: bytes, found: list) -> str:
    out, at, n = [], 0, 0
    for start, end, kind, _ in found:
        n += len(b[at:start].decode())
        size = end - start  # a find is ASCII
        out.append(f"{kind}:{n}:{n + size}")
        n, at = n + size, end
    return ",".join(out)


def pseudonymise(docs: DataFrame, key: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: ``doc_id``, ``text`` with its pseudonyms, ``n_found``, ``spans`` (kind:start:end in code points of
    the text as it was, end exclusive, comma-joined).

    One pass over whole texts, no shuffle. A null text stays null and has no finds; repeated rows get the same text;
    null ids stay null; further columns are ignored; no rows give no rows.
    """
    secret = key if key is not None else docs.sparkSession.conf.get(KEY_CONF, KEY)
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("text", T.StringType()), T.StructField("n_found", T.LongType()), T.StructField("spans", T.StringType())])

    def run(batches):
        p = Pseudonyms(secret)
        for batch in slices(batches):
            old = batch.column(1).cast(pa.binary()).to_pylist()
            found = [find(b, p) if b else [] for b in old]
            new = [replace(b, f) if f else b for b, f in zip(old, found, strict=True)]
            spans = [_spans(b, f) if f else "" for b, f in zip(old, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.binary()).cast(batch.schema.field(1).type), pa.array(list(map(len, found)), pa.int64()), pa.array(spans)], names=["doc_id", "text", "n_found", "spans"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, schema)
