"""PII: format-preserving Feistel pseudonyms.

Numbers, dates and addresses that pass their validation are replaced by keyed
permutations of themselves within their format: a card number becomes another
card number with a right check digit, a date another date. A permutation is a
function of the key and the value only, so equal values stay equal in every
document, different values stay different, and the key's holder can go back.

The permutation is a Feistel network over the characters that may change, each
in its own alphabet: the halves take turns in being shifted, character by
character, by a keyed hash of the other half. Where not every string of the
format is valid (area codes, dates), the network walks on until one is.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_DIGITS, _LOWER, _UPPER, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"


def _alphabet(c: str) -> str | None:
    return next((a for a in (_DIGITS, _LOWER, _UPPER) if c in a), None)


def feistel(key: bytes, tweak: str, digits: list[int], radices: list[int], back: bool = False) -> list[int]:
    """A keyed permutation of the strings with these radices (of one character: a shift)."""
    half = len(digits) // 2
    left, right = list(digits[:half]), list(digits[half:])
    for i in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
        fixed, moved, base = (left, right, radices[half:]) if i % 2 else (right, left, radices[:half])
        if not moved:
            continue
        seed = hashlib.blake2b(f"{tweak}|{i}|{len(digits)}|{fixed if half else ''}".encode(), key=key, digest_size=64).digest()
        while len(seed) < 4 * len(moved):
            seed += hashlib.blake2b(seed[-64:], key=key, digest_size=64).digest()
        for j, b in enumerate(base):
            shift = int.from_bytes(seed[4 * j : 4 * j + 4], "little")
            moved[j] = (moved[j] - shift if back else moved[j] + shift) % b
    return left + right


def permuted(key: bytes, tweak: str, value: str, free: list[int], valid: Callable[[str], bool], back: bool = False) -> str:
    """``value`` with the characters at ``free`` permuted, walking on until the result is valid."""
    alphabets = [_alphabet(value[i]) for i in free]
    places, chars = [i for i, a in zip(free, alphabets, strict=True) if a], list(value)
    sets = [a for a in alphabets if a]
    if not places:
        return value
    digits = [a.index(value[i]) for i, a in zip(places, sets, strict=True)]
    while True:
        digits = feistel(key, tweak, digits, [len(a) for a in sets], back)
        for i, a, d in zip(places, sets, digits, strict=True):
            chars[i] = a[d]
        if valid(got := "".join(chars)):
            return got


def luhn(number: str) -> int:
    """The check digit that completes the digits."""
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _only(text: str, alphabet: str = _DIGITS) -> str:
    return "".join(c for c in text if c in alphabet)


def _at(value: str, alphabet: str = _DIGITS) -> list[int]:
    return [i for i, c in enumerate(value) if c in alphabet]


def _card_valid(value: str) -> bool:
    d = _only(value)
    return 13 <= len(d) <= 19 and d[0] in "23456" and luhn(d[:-1]) == int(d[-1])


def _card(key: bytes, value: str, back: bool = False) -> str:
    at = _at(value)
    got = permuted(key, "card", value, at[1:-1], lambda _: True, back)
    return got[: at[-1]] + str(luhn(_only(got)[:-1])) + got[at[-1] + 1 :]


def _phone_plan(value: str) -> bool:
    """Whether area and exchange code are those of the North American plan."""
    d = _only(value)
    d = d[1:] if len(d) == 11 and d[0] == "1" else d
    return len(d) == 10 and d[0] in "23456789" and d[3] in "23456789" and d[1:3] != "11"


def _phone_valid(value: str) -> bool:
    """A country code or brackets show a phone number, whatever its codes; bare groups need codes of the plan."""
    return value[0] in "+(" or "(" in value or _phone_plan(value)


def _phone(key: bytes, value: str, back: bool = False) -> str:
    """Numbers of the plan and others each stay among themselves."""
    at, planned = _at(value), _phone_plan(value)
    return permuted(key, "phone", value, at[-10:], lambda v: _phone_plan(v) == planned, back)


def _ssn_valid(value: str) -> bool:
    d = _only(value)
    return len(d) == 9 and d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ip_valid(value: str) -> bool:
    return all(p.isdigit() and int(p) < 256 and (p == "0" or p[0] != "0") for p in value.split("."))


def _ip(key: bytes, value: str, back: bool = False) -> str:
    octets = [int(p) for p in value.split(".")]
    return ".".join(map(str, feistel(key, "ip", octets, [256] * 4, back)))


def _email(key: bytes, value: str, back: bool = False) -> str:
    """All letters and digits before the last dot; the top-level domain stays."""
    return permuted(key, "email", value, list(range(value.rindex("."))), lambda _: True, back)


_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
_DATE = re.compile(r"(\d{4})([-/.])(\d{2})\2(\d{2})|(\d{2})([-/.])(\d{2})\6(\d{4})")


def _date_of(value: str) -> tuple[datetime.date, str] | None:
    """The date and its format: year first, or else day first if that is valid, or month first."""
    m = _DATE.fullmatch(value)
    if not m:
        return None
    tries = [(m[1], m[3], m[4], f"%Y{m[2]}%m{m[2]}%d")] if m[1] else [(m[8], m[7], m[5], f"%d{m[6]}%m{m[6]}%Y"), (m[8], m[5], m[7], f"%m{m[6]}%d{m[6]}%Y")]
    for y, mo, d, form in tries:
        try:
            day = datetime.date(int(y), int(mo), int(d))
        except ValueError:
            continue
        if _FIRST <= day.toordinal() <= _LAST:
            return day, form
    return None


def _date(key: bytes, value: str, back: bool = False) -> str:
    day, form = _date_of(value)
    n = day.toordinal() - _FIRST
    span = _LAST - _FIRST + 1
    while True:
        a, b = feistel(key, f"date{form}", list(divmod(n, 512)), [span // 512 + 1, 512], back)
        n = a * 512 + b
        if n < span:
            text = (datetime.date.fromordinal(_FIRST + n)).strftime(form)
            # Month first only stays so where day first is not valid.
            if _date_of(text)[1] == form:
                return text


def _iban_valid(value: str) -> bool:
    v = value.replace(" ", "")
    # Check digits are 02 to 98: 00, 01 and 99 are equal to others modulo 97, and two numbers would share a pseudonym.
    return 15 <= len(v) <= 34 and "02" <= v[2:4] <= "98" and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _iban(key: bytes, value: str, back: bool = False) -> str:
    at = [i for i, c in enumerate(value) if c != " "]
    got = permuted(key, "iban", value, at[4:], lambda _: True, back)
    v = got.replace(" ", "")
    check = 98 - int("".join(str(int(c, 36)) for c in v[4:] + v[:2] + "00")) % 97
    chars = list(got)
    chars[at[2]], chars[at[3]] = f"{check:02d}"
    return "".join(chars)


@dataclass(frozen=True)
class Kind:
    """A kind of value: candidates by pattern, validation, permutation."""

    name: str
    pattern: str
    valid: Callable[[str], bool]
    permute: Callable[..., str]
    flags: int = field(default=re.ASCII)


#: In order of precedence where candidates overlap; fixed patterns.
KINDS = (
    Kind("email", r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", lambda v: ".." not in v, _email),
    Kind("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", _iban_valid, _iban),
    Kind("ip", r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)", _ip_valid, _ip),
    Kind("card", r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w]|[.-]\d)", _card_valid, _card),
    Kind("date", r"(?<![\w/.-])(?:\d{4}([-/.])\d{2}\1\d{2}|\d{2}([-/.])\d{2}\2\d{4})(?![\w]|[/.-]\d)", lambda v: _date_of(v) is not None, _date),
    Kind("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w]|-\d)", _ssn_valid, lambda k, v, back=False: permuted(k, "ssn", v, _at(v), _ssn_valid, back)),
    Kind("phone", r"(?<![\w.-])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w]|[.-]\d)", _phone_valid, _phone),
)


class Pseudonyms:
    """The replacements of one key, each worked out once, up to a bound."""

    def __init__(self, key: bytes, kinds: tuple[Kind, ...] = KINDS):
        self.key, self.kinds = key, kinds
        self.patterns = [(k, re.compile(k.pattern, k.flags)) for k in kinds]
        # A text without a digit before or after these characters, or an @, has no candidate.
        self.any = re.compile(r"@|\d[ .()/-]{0,2}\d", re.ASCII)
        self.known: dict[tuple[str, str], str] = {}

    def replace(self, kind: Kind, value: str) -> str:
        at = (kind.name, value)
        if at not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[at] = kind.permute(self.key, value)
        return self.known[at]

    def spans(self, text: str) -> list[tuple[int, int, Kind]]:
        """Validated values: where kinds overlap the earlier kind's counts."""
        if not self.any.search(text):
            return []
        taken: list[tuple[int, int, Kind]] = []
        for kind, pattern in self.patterns:
            starts = [x[0] for x in taken]
            new = []
            for m in pattern.finditer(text):
                # What is taken doesn't overlap, so only the last that begins before the end can be in the way.
                at = bisect.bisect_left(starts, m.end())
                if kind.valid(m[0]) and (at == 0 or taken[at - 1][1] <= m.start()):
                    new.append((m.start(), m.end(), kind))
            if new:
                taken = sorted(taken + new, key=lambda x: x[0])
        return taken

    def text(self, text: str) -> tuple[str, list[tuple[int, int, Kind]]]:
        found, out, at = self.spans(text), [], 0
        for start, end, kind in found:
            out += [text[at:start], self.replace(kind, text[start:end])]
            at = end
        return "".join([*out, text[at:]]) if found else text, found


def pseudonymize(docs: DataFrame, key: bytes, column: str = "text", counts: bool = True) -> DataFrame:
    """All rows and columns of ``docs`` with the values in ``column`` replaced.

    Whoever has ``key`` can undo the pseudonyms. With ``counts``, adds
    pii_<kind> for each kind (replacing columns of these names). A null text
    stays null and an empty one empty, with zero counts; every row is on its
    own, so repeated rows get equal results; an empty table gives no rows.
    """
    names = [f"pii_{k.name}" for k in KINDS] if counts else []
    docs = docs.drop(*names)
    schema = docs.withColumns({n: F.lit(0) for n in names}).schema if names else docs.schema
    at = docs.columns.index(column)

    def run(batches):
        known = Pseudonyms(key)
        for batch in batches:
            got = [known.text(t) if t is not None else (None, []) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array([t for t, _ in got], batch.schema.types[at])
            for k in KINDS if counts else ():
                columns.append(pa.array([sum(x[2].name == k.name for x in f) for _, f in got], pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)
