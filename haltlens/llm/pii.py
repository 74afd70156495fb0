"""PII: format-preserving pseudonyms by keyed Feistel permutations.

Found values are validated, then permuted within their format under a secret key: digits stay digits, letters stay letters,
separators stay where they are and check digits are made right again, so that equal values get equal pseudonyms in all
documents and different values different ones. Kinds, with what validates them:

- card: 13 to 19 digits that pass the Luhn check; the last digit is computed anew
- iban: country, two check digits that pass mod 97; the account part is permuted, the check digits computed anew
- phone: an international or bracketed number of 7 to 15 digits; the country code stays
- ip: four numbers up to 255, permuted as one 32-bit number; six or more groups of hexadecimal pairs (mac) likewise
- ssn: three, two and four digits with possible area, group and serial number
- date: a day of the calendar between 1900 and 2099, in digits or with a month's name, permuted among all of them, so that a day has one pseudonym in
  all ways of writing it. With the year last the day comes first, unless only the other order makes a date (after a month a day above 12): such a one is permuted
  among its like. Separators stay; single digits stay without a leading zero where the value has one of them
- email: local part and the host's first label are permuted letter by letter class; the rest of the host stays
- secret: a value of 16 or more characters, a digit among them, assigned to a name such as token, key, secret or password; a
  known key prefix; or a bare hexadecimal word of 40 or 64

The Feistel network has 10 rounds over the mixed-radix number that the variable positions spell, halves of nearly equal
size, rounds keyed by BLAKE2b with kind, format and round; numbers outside the domain are walked on along the cycle.

Defined results: null text stays null with no findings; empty text likewise has none; very long texts are scanned whole, a few at a time; an empty table stays empty;
values that fail validation are left alone, but for such of their runs of whole groups as pass; overlapping findings go to the kind listed first. Repeated rows give repeated results.
"""

from __future__ import annotations

import datetime
import re
from bisect import bisect_left
from functools import lru_cache
from hashlib import blake2b
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

ROUNDS = 10
_DAY0, _DAYS = datetime.date(1900, 1, 1).toordinal(), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days
KINDS = ("email", "iban", "card", "phone", "ip", "mac", "ssn", "date", "secret")


def permuted(x: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of range(size): unbalanced Feistel over a * b >= size, walked along the cycle into range."""
    if size < 2:
        return x
    a = isqrt(size - 1) + 1
    b = -(-size // a)
    while True:
        left, right = divmod(x, b)
        for r in range(ROUNDS):
            if r % 2:
                right = (right + int.from_bytes(blake2b(tweak + b"%d|%d" % (r, left), key=key, digest_size=16).digest(), "big")) % b
            else:
                left = (left + int.from_bytes(blake2b(tweak + b"%d|%d" % (r, right), key=key, digest_size=16).digest(), "big")) % a
        x = left * b + right
        if x < size:
            return x


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_CLASS_OF = {c: (alphabet, i) for alphabet in _CLASSES for i, c in enumerate(alphabet)}


def spelled(s: str, key: bytes, tweak: bytes) -> str:
    """``s`` with its ASCII digits and letters permuted together, each within its class; all else stays."""
    x, size = 0, 1
    shape = []
    for c in s:
        if found := _CLASS_OF.get(c):
            x, size = x * len(found[0]) + found[1], size * len(found[0])
            shape.append(found[0][0])
        else:
            shape.append(c if c.isascii() else "?")
    x = permuted(x, size, key, tweak + "".join(shape).encode() + b"|")
    out = []
    for c in reversed(s):
        if found := _CLASS_OF.get(c):
            x, i = divmod(x, len(found[0]))
            c = found[0][i]
        out.append(c)
    return "".join(reversed(out))


def luhn(digits: str) -> int:
    """The Luhn sum mod 10 of a digit string: 0 if its check digit is right."""
    return sum(int(d) if i % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for i, d in enumerate(reversed(digits))) % 10


def _into(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def card(s: str, key: bytes) -> str | None:
    d = _digits(s)
    if not 13 <= len(d) <= 19 or luhn(d) or len(set(d)) == 1:
        return None
    body = spelled(d[:-1], key, b"card|")
    return _into(s, body + str(-luhn(body + "0") % 10))


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s)) % 97


def iban(s: str, key: bytes) -> str | None:
    flat = s.replace(" ", "")
    if not 15 <= len(flat) <= 34 or _mod97(flat[4:] + flat[:4]) != 1:
        return None
    body = spelled(flat[4:], key, b"iban|")
    flat = iter(flat[:2] + f"{98 - _mod97(body + flat[:2] + '00'):02d}" + body)
    return "".join(c if c == " " else next(flat) for c in s)


def phone(s: str, key: bytes) -> str | None:
    head = re.match(r"(?:\+|00)\d{1,3}(?=[ ().-])|\+\d{1,2}", s)
    at = head.end() if head else 0
    d = _digits(s[at:])
    return s[:at] + _into(s[at:], spelled(d, key, b"phone|" + s[:at].encode())) if 7 <= len(_digits(s)) <= 15 and len(d) >= 6 else None


def ip(s: str, key: bytes) -> str | None:
    p = s.split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in p):
        return None
    x = permuted(int.from_bytes(bytes(map(int, p)), "big"), 1 << 32, key, b"ip|")
    return ".".join(map(str, x.to_bytes(4, "big")))


def mac(s: str, key: bytes) -> str:
    sep = s[2]
    x = permuted(int(s.replace(sep, ""), 16), 1 << 48, key, b"mac|")
    out = sep.join(f"{b:02x}" for b in x.to_bytes(6, "big"))
    return out.upper() if s.upper() == s else out


def ssn(s: str, key: bytes) -> str | None:
    area, group, serial = int(s[:3]), int(s[4:6]), int(s[7:])
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    x = permuted(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, key, b"ssn|")
    x, serial = divmod(x, 9999)
    area, group = divmod(x, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


#: Names of months: English, short and long, German, French, Spanish.
_MONTHS = tuple(x.split() for x in (
    "january february march april may june july august september october november december",
    "jan feb mar apr may jun jul aug sep oct nov dec",
    "januar februar märz april mai juni juli august september oktober november dezember",
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
))
_MONTH_OF = {name: (names, i + 1) for names in reversed(_MONTHS) for i, name in enumerate(names)} | {"sept": (_MONTHS[1], 9)}
_NAMED_DATE = re.compile(rf"(?i)(?P<d>[0-9]{{1,2}})(?P<o>st|nd|rd|th|er)?\.? (?:of |de )?(?P<m>{(names := '|'.join(sorted(_MONTH_OF, key=len, reverse=True)))})\.?,? (?:de )?(?P<y>(?:19|20)[0-9]{{2}})|(?P<m2>{names})\.? (?P<d2>[0-9]{{1,2}})(?P<o2>st|nd|rd|th)?,? (?P<y2>(?:19|20)[0-9]{{2}})")


def _named_date(m: re.Match, key: bytes) -> str | None:
    two = "" if m["m"] else "2"
    names, month = _MONTH_OF[m["m" + two].lower()]
    try:
        day = datetime.date(int(m["y" + two]), month, int(m["d" + two])).toordinal() - _DAY0
    except ValueError:
        return None
    d = datetime.date.fromordinal(_DAY0 + permuted(day, _DAYS, key, b"date|"))
    was, name = m["m" + two], names[d.month - 1]
    new = {"m": name.upper() if was.isupper() else name if was.islower() else name.capitalize(), "d": f"{d.day:02d}" if m["d" + two][0] == "0" else str(d.day), "y": str(d.year)}
    if (o := m["o" + two]) and o.lower() != "er":
        new["o"] = "th" if d.day in (11, 12, 13) else {1: "st", 2: "nd", 3: "rd"}.get(d.day % 10, "th")
    out, at = [], 0
    for a, b, x in sorted((*m.span(g + two), x) for g, x in new.items()):
        out += [m.string[at:a], x]
        at = b
    return "".join([*out, m.string[at:]])


def date(s: str, key: bytes) -> str | None:
    if named := _NAMED_DATE.fullmatch(s):
        return _named_date(named, key)
    sep = next(c for c in s if not c.isdigit())
    p = s.split(sep)
    iso = len(p[0]) == 4
    american = not iso and sep in "/-" and int(p[1]) > 12
    order = (0, 1, 2) if iso else (2, 0, 1) if american else (2, 1, 0)
    try:
        day = datetime.date(*(int(p[i]) for i in order)).toordinal() - _DAY0
    except ValueError:
        return None
    if not 0 <= day < _DAYS:
        return None
    while True:
        day = permuted(day, _DAYS, key, b"date|")
        d = datetime.date.fromordinal(_DAY0 + day)
        if not american or d.day > 12:  # walked on along the cycle, so that the new value is read in the same order
            break
    width = 1 if 1 in map(len, p) else 2
    new = {order[0]: f"{d.year:04d}", order[1]: f"{d.month:0{width}d}", order[2]: f"{d.day:0{width}d}"}
    return sep.join(new[i] for i in range(3))


def email(s: str, key: bytes) -> str:
    local, host = s.rsplit("@", 1)
    first, dot, rest = host.partition(".")
    return f"{spelled(local, key, b'local|')}@{spelled(first, key, b'host|')}{dot}{rest}"


def secret(s: str, key: bytes) -> str:
    if re.fullmatch(r"[0-9a-f]+", s):
        x = permuted(int(s, 16), 16 ** len(s), key, b"hex%d|" % len(s))
        return f"{x:0{len(s)}x}"
    known = re.match(r"(?:AKIA|ASIA|gh[pousr]_|sk-|xox[abp]-|AIza|glpat-)", s)
    at = known.end() if known else 0
    return s[:at] + spelled(s[at:], key, b"secret|" + s[:at].encode())


#: Where each kind may stand; group 1 is the value.
_FINDS = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"),
    "iban": re.compile(r"(?<![A-Za-z0-9])([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?)(?![A-Za-z0-9])"),
    "card": re.compile(r"(?<![0-9A-Za-z])([0-9]+(?:[ -][0-9]+)*)(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![\w+])(\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?!\w)"),
    "ip": re.compile(r"(?<![\w.])([0-9]{1,3}(?:\.[0-9]{1,3}){3})(?!\w|\.[0-9])"),
    "mac": re.compile(r"(?<![\w:-])([0-9A-Fa-f]{2}([:-])(?:[0-9A-Fa-f]{2}\2){4}[0-9A-Fa-f]{2})(?![\w:-])"),
    "ssn": re.compile(r"(?<![\w-])([0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w-])"),
    "date": re.compile(rf"(?<![\w./-])((?:19|20)[0-9]{{2}}([-/.])[0-9]{{1,2}}\2[0-9]{{1,2}}|[0-9]{{1,2}}([-/.])[0-9]{{1,2}}\3(?:19|20)[0-9]{{2}}|{_NAMED_DATE.pattern.replace('(?i)', '(?i:', 1)}))(?!(?!T[0-9]{{2}}:?[0-9]{{2}})\w|[/-]|\.[0-9])"),
    "secret": re.compile(
        r"((?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|xox[abp]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20,})"
        r"|(?<![A-Za-z0-9])(?:[0-9a-f]{64}|[0-9a-f]{40})(?![A-Za-z0-9])"
        r"|(?<=[=:\"' ])(?<![A-Za-z0-9_])[A-Za-z0-9_+/-]*[0-9][A-Za-z0-9_+/-]{7,}(?![A-Za-z0-9]))"
    ),
}
_SURE = re.compile(r"AKIA|ASIA|gh[pousr]_|sk-|xox[abp]-|AIza|glpat-|(?:[0-9a-f]{40}|[0-9a-f]{64})$")
_NAMED = re.compile(r"(?i)(?:api[ _-]?key|access[ _-]?key|auth|bearer|credentials?|passw(?:or)?d|private[ _-]?key|pwd|secret|token)[\"']?\s*(?:[:=]|\bis\b)\s*[\"']?$")
_DIGIT = re.compile(r"[0-9]")
_MAKE = {"email": email, "iban": iban, "card": card, "phone": phone, "ip": ip, "mac": mac, "ssn": ssn, "date": date, "secret": secret}


#: Characters of an IBAN by country.
_IBAN = {c: int(x[:2]) for x in "15NO 16BE 18DKFIFKFOGLNLSD 19MKSI 20ATBAEEKZLTLUMNXK 21CHHRLILV 22BGBHCRDEGBGEIEMERSVA 23AEGIILIQOMSOTL 24ADCZESMDPKROSASESKTNVG 25LYPTST 26ISTR 27BIDJFRGRITMCMRSM 28ALAZBYCYCZDOGTHUNILBPLSV 29BREGPSQAUA 30JOKWMUYE 31MTSC 32LC 33RU".split() for c in re.findall("..", x[2:]) if (x[:2], c) != ("28", "CZ")}
_GROUPS = {"iban": re.compile(r"[A-Z0-9]+"), "card": re.compile(r"[0-9]+"), "phone": re.compile(r"[0-9]+")}


def runs(kind: str, value: str) -> list[tuple[int, int]]:
    """The stretches of a candidate that may be a value, by preference: such as begin and end at borders of its groups."""
    if kind not in _GROUPS:
        return [(0, len(value))]
    groups = [m.span() for m in _GROUPS[kind].finditer(value)]
    if kind == "phone":  # a number begins where it does
        return [(0, len(value)), *((0, b) for _, b in reversed(groups[:-1]))]
    found = []
    for i, (a, _) in enumerate(groups):
        size, sizes = 0, []
        for c, b in groups[i:]:
            size += b - c
            sizes.append(b - c)
            if size > (34 if kind == "iban" else 19):
                break
            if kind == "iban" and size >= 15 and re.match("[A-Z]{2}[0-9]{2}", value[a:b]):
                found.append((size != _IBAN.get(value[a : a + 2]), a, -b))
            elif kind == "card" and size >= 13 and not luhn(_digits(value[a:b])):
                usual = len(sizes) == 1 or sizes in ([4, 6, 5], [4, 6, 4]) or (set(sizes[:-1]) == {4} and size in (13, 16, 19))
                found.append((not usual or size == 19, a, -b))
    return [(a, -b) for _, a, b in sorted(found)]


@lru_cache(maxsize=50_000)
def pseudonym(kind: str, value: str, key: bytes) -> str | None:
    """None: the value is not valid as one of its kind."""
    return _MAKE[kind](value, key)


def findings(text: str, key: bytes) -> list[tuple[int, int, str, str]]:
    """Start, end, kind and pseudonym of each finding, in order; none overlap."""
    kinds = KINDS if _DIGIT.search(text) else ("email",) if "@" in text else ()
    found: list[tuple[int, int, str, str]] = []
    for kind in kinds:
        for m in _FINDS[kind].finditer(text):
            value, start = m.group(1), m.start(1)
            if kind == "secret" and not _SURE.match(value) and not (len(value) >= 16 and _NAMED.search(text[max(0, start - 40) : start])):
                continue
            for a, b in runs(kind, value):
                a, b = start + a, start + b
                i = bisect_left(found, (a,))
                if (i and found[i - 1][1] > a) or (i < len(found) and found[i][0] < b):
                    continue
                if (new := pseudonym(kind, text[a:b], key)) is not None:
                    found.insert(i, (a, b, kind, new))
    return found


def pseudonymised(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    """The text with its findings replaced, and how many there were of each kind."""
    out, at, n = [], 0, {}
    for start, end, kind, new in findings(text, key):
        out += [text[at:start], new]
        at, n[kind] = end, n.get(kind, 0) + 1
    return ("".join([*out, text[at:]]) if out else text), n


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` replaced; more columns: n_<kind> long for each kind. All columns of ``docs`` stay (a clash with n_<kind> is the operator's to win)."""
    counts = [f"n_{k}" for k in KINDS]
    docs = docs.drop(*counts)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"{c} long" for c in counts)])

    def run(batches):
        for b in sliced(batches):
            new, found = [], []
            for t in b.column(text).to_pylist():
                r = pseudonymised(t, key) if t else (t, {})
                new.append(r[0])
                found.append(r[1])
            cols = [pa.array(new, pa.string()) if n == text else b.column(n) for n in b.schema.names]
            yield pa.RecordBatch.from_arrays(cols + [pa.array([f.get(k, 0) for f in found], pa.int64()) for k in KINDS], b.schema.names + counts)

    return docs.mapInArrow(run, schema)


def total() -> F.Column:
    return sum((F.col(f"n_{k}") for k in KINDS[1:]), F.col(f"n_{KINDS[0]}"))
