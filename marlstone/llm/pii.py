"""Personal data: patterns propose spans, checksums confirm, context scores.

Base kinds (email, ip, card, phone) follow fixed patterns, leftmost and without
overlaps within a kind; a match that fails its check is dropped and not retried.
Further kinds are proposed more widely and must earn their place: an IBAN by its
mod-97 remainder, a social security number or a national phone number by its
form and by words that name such a number nearby.  Further spans overlap neither
base spans nor each other.  Every span gets a score; base spans stay whatever
their score.

Patterns are matched in time linear in the text: an address is grown from its
"@", digit runs are entered at their first digit only, and quantifiers that
cannot give back are possessive.

Edge cases: a null text is empty; spans are in code points; rows that repeat
get the same spans; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, shipped, tidy

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "local_phone")
#: Spans of further kinds count from this score on.
ACCEPT = 0.6
#: Characters on either side in which context words count.
NEAR = 40

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?=\x20?[A-Z0-9])")
# Characters of an account number by country (ISO 13616).
_IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_IBAN_REST = {n: re.compile(rf"(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in set(_IBAN_LENGTHS.values())}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NATIONAL = re.compile(r"(?<![0-9+)(.-])\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[^\W\d_]+")

_FOR = {
    "email": {"email", "mail", "contact", "correo", "courriel"},
    "ip": {"ip", "address", "host", "server", "adresse"},
    "card": {"card", "visa", "mastercard", "credit", "debit", "payment", "carte", "karte", "tarjeta"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"},
    "iban": {"iban", "account", "bank", "konto", "compte", "cuenta"},
    "ssn": {"ssn", "social", "security", "tax"},
    "local_phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"},
}
_AGAINST = {"example", "sample", "version", "isbn", "order", "invoice", "serial"}
_START = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.75, "iban": 0.9, "ssn": 0.4, "local_phone": 0.4}


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def _emails(t: str) -> Iterator[tuple[int, int]]:
    end, at = 0, t.find("@")
    while at >= 0:
        m = _DOMAIN.match(t, at + 1)
        start = at
        if m:
            while start > end and t[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at:
                end = m.end()
                yield start, end
        at = t.find("@", max(at + 1, end))


def _octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def _score(t: str, kind: str, a: int, z: int) -> float:
    near = {w.lower() for w in _WORD.findall(t[max(0, a - NEAR) : a])} | {w.lower() for w in _WORD.findall(t[z : z + NEAR])}
    return round(min(1.0, max(0.0, _START[kind] + 0.3 * bool(near & _FOR[kind]) - 0.3 * bool(near & _AGAINST))), 2)


def _ibans(t: str) -> Iterator[tuple[int, int]]:
    """Account numbers of their country's length; what follows is not theirs."""
    for m in _IBAN.finditer(t):
        rest = m[1] in _IBAN_LENGTHS and _IBAN_REST[_IBAN_LENGTHS[m[1]]].match(t, m.end())
        if rest and mod97(t[m.start() : rest.end()].replace(" ", "")):
            yield m.start(), rest.end()


class _Taken:
    """Places that spans cover, as disjoint runs in order."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, z in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], z)
            else:
                self.starts.append(a)
                self.ends.append(z)

    def take(self, a: int, z: int) -> bool:
        """Cover [a, z) unless a part of it is covered."""
        i = bisect_left(self.starts, z)
        if i and self.ends[i - 1] > a:
            return False
        self.starts.insert(i, a)
        self.ends.insert(i, z)
        return True


def find(t: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of all spans, by kind as listed, then start."""
    found: list[tuple[str, int, int]] = []
    if "@" in t:
        found += [("email", a, z) for a, z in _emails(t)]
    if _DIGIT.search(t):
        found += [("ip", *m.span()) for m in _IP.finditer(t) if _octets(m.group())]
        for m in _CARD.finditer(t):
            if m.end() - m.start() >= 13:
                d = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(d) <= 19 and luhn(d):
                    found.append(("card", *m.span()))
        if "+" in t:
            found += [("phone", *m.span()) for m in _PHONE.finditer(t) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
        more = [("iban", a, z) for a, z in _ibans(t)]
        if "-" in t:
            more += [("ssn", *m.span()) for m in _SSN.finditer(t) if m.group()[:3] not in ("000", "666") and m.group()[0] != "9" and m.group()[4:6] != "00" and m.group()[7:] != "0000"]
        more += [("local_phone", *m.span()) for m in _NATIONAL.finditer(t)]
        taken = _Taken([(a, z) for _, a, z in found])
        found += [(kind, a, z) for kind, a, z in more if _score(t, kind, a, z) >= ACCEPT and taken.take(a, z)]
    return [(k, a, z, _score(t, k, a, z)) for k, a, z in found]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def _finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans, digests, counts = [], [], []
        for t in b.column(1):
            found = find(t.as_py() or "")
            base = [f"{k}:{a}:{z}" for k, a, z, _ in found if k in BASE]
            spans.append([dict(zip(("kind", "start", "end", "score"), f, strict=True)) for f in found])
            digests.append(hashlib.sha256(",".join(base).encode()).hexdigest())
            counts.append([sum(f[0] == k for f in found) for k in BASE])
        columns = [b.column(0), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(len(BASE))), pa.array(digests, pa.string()), pa.array(spans, _SPANS)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "found"])


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_<kind> of each base kind, base_sha256 and ``found``: an array
    of (kind, start, end, score)."""
    shipped(docs.sparkSession)
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, found array<struct<kind:string,start:int,end:int,score:double>>"
    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(tidy(_finder), schema)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(documents(spark, sf_dir))
    joined = "array_join(transform(found, s -> concat(s.kind, ':', s.start, ':', s.end)), ',') AS spans"
    return found.selectExpr("doc_id", *(f"n_{k}" for k in BASE), "base_sha256", joined, "array_join(transform(found, s -> s.score), ',') AS scores")
