"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby move their scores.

A proposal starts with its kind's own score; a confirmed checksum raises it, a word that names the kind
within 40 characters raises it, one that names something else (order, version, ...) lowers it.  Spans of the four base kinds
are reported whatever their score; the other kinds need the score ``threshold`` and a place that no base
span has taken.  Every pattern is read so that a text costs time in proportion to its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import small_batches

#: In the order of reports.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "short_card", "ssn", "local_phone")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_RUN = re.compile(r"[0-9]+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3,}")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")

# Lengths of account numbers by country, as their registry publishes them.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "BR": 29, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27,
    "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18,
    "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26, "UA": 29,
}

#: Words that speak for a kind, and words that speak for another reading.
FOR = {
    "email": "email e-mail mail contact courriel correo kontakt",
    "ip": "ip address host server client ping adresse dirección",
    "card": "card credit debit visa mastercard amex payment karte carte tarjeta",
    "phone": "phone tel telephone call mobile cell fax telefon téléphone teléfono",
    "iban": "iban account bank konto compte cuenta",
    "short_card": "card credit debit visa amex diners payment karte carte tarjeta",
    "ssn": "ssn social security",
    "local_phone": "phone tel telephone call mobile cell fax telefon téléphone teléfono",
}
AGAINST = {
    "email": "example",
    "ip": "version release build chapter section",
    "card": "order invoice isbn tracking serial",
    "phone": "order invoice isbn serial",
    "iban": "serial part model",
    "short_card": "order invoice isbn tracking serial timestamp",
    "ssn": "order invoice serial part",
    "local_phone": "order invoice isbn serial part",
}
_WORD = re.compile(r"(?<![^\W\d_])[^\W\d_]+(?:-[^\W\d_]+)*")
#: Characters within which any context word ends.
_LONGEST = 64
_FOR = {k: frozenset(v.split()) for k, v in FOR.items()}
_AGAINST = {k: frozenset(v.split()) for k, v in AGAINST.items()}
#: Score of a proposal by kind, before checksums and context.
START = {"email": 0.9, "ip": 0.6, "card": 0.4, "phone": 0.7, "iban": 0.3, "short_card": 0.1, "ssn": 0.4, "local_phone": 0.4}
CHECKED = 0.4


@dataclass(frozen=True)
class PiiParams:
    """``window``: characters on both sides that are searched for context; ``shift``: what such words add or take."""

    threshold: float = 0.6
    window: int = 40
    shift: float = 0.3


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number (capitals and digits) leaves 1 modulo 97 once its first four characters stand last."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, @ and dotted domain: each @ is looked at once, with the run of local characters before it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        found = _AT.match(text, at) if start < at else None
        if found:
            yield start, found.end()
        end = found.end() if found else at + 1
        at = text.find("@", end)


def _matches(text: str, starts: list[int], pattern: re.Pattern, before: int = 0) -> Iterator[re.Match]:
    """Non-overlapping matches from left to right that begin ``before`` characters before one of the starts."""
    end = 0
    for at in starts:
        if at - before >= end and (m := pattern.match(text, at - before)):
            end = m.end()
            yield m


def addresses(text: str, runs: list[int]) -> Iterator[tuple[int, int]]:
    """Four parts at most 255 of a dotted chain of numbers, then the next four."""
    for chain in _matches(text, runs, _DOTTED):
        parts, at = chain.group().split("."), chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def cards(text: str, runs: list[int], least: int, most: int) -> Iterator[tuple[int, int]]:
    """Chains of digits, with single spaces or hyphens between them, of a card's length and with its check digit."""
    for m in _matches(text, runs, _DIGITS):
        if least <= m.end() - m.start() <= 2 * most and least <= len(d := _digits(m.group())) <= most and luhn(d):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("+")
    while at >= 0:
        m = _PLUS.match(text, at)
        if m and 8 <= len(_digits(m.group())) <= 15:
            yield m.span()
        at = text.find("+", m.end() if m else at + 1)


def accounts(text: str, runs: list[int]) -> Iterator[tuple[int, int]]:
    """International account numbers of their country's length, in groups or not, that pass modulo 97."""
    end = 0
    for run in runs:
        m = _IBAN.match(text, run - 2) if run - 2 >= end else None
        need, at = (IBAN_LENGTHS.get(m.group()[:2], 0), m.start()) if m else (0, 0)
        if need:
            while need and at < m.end():
                need -= text[at] != " "
                at += 1
            if not need and not text[at : at + 1].isalnum() and mod97(text[m.start() : at].replace(" ", "")):
                yield m.start(), at
                end = at


def local_phones(text: str, runs: list[int]) -> Iterator[tuple[int, int]]:
    starts = [run - (text[run - 1 : run] == "(") for run in runs]
    return (m.span() for m in _matches(text, starts, _LOCAL_PHONE))


def _possible_ssn(text: str) -> bool:
    return text[:3] not in ("000", "666") and text[0] != "9" and text[4:6] != "00" and text[7:] != "0000"


def spans(text: str | None, params: PiiParams = PiiParams()) -> list[Span]:
    """All spans by kind (base kinds first), then start."""
    if not text:
        return []
    runs = [m.start() for m in _RUN.finditer(text)]
    proposed = {"email": emails(text), "ip": addresses(text, runs), "card": cards(text, runs, 16, 19), "phone": phones(text)}
    out = [Span(kind, a, b, _score(text, kind, a, b, kind == "card", params)) for kind, found in proposed.items() for a, b in found]
    taken, added = [(s.start, s.end) for s in out], []
    if runs:
        ssn = (m.span() for m in _matches(text, runs, _SSN) if _possible_ssn(m.group()))
        more = {"iban": accounts(text, runs), "short_card": cards(text, runs, 13, 15), "ssn": ssn, "local_phone": local_phones(text, runs)}
        proposals = [Span(kind, a, b, _score(text, kind, a, b, kind in ("iban", "short_card"), params)) for kind, found in more.items() for a, b in found]
        added = [s for s in proposals if s.score >= params.threshold]
    return out + _apart(added, taken) if added else out


def _apart(added: list[Span], taken: list[tuple[int, int]]) -> list[Span]:
    """Added spans that touch neither a base span nor an added one of an earlier kind."""
    inside = set()
    for a, b in taken:
        inside.update(range(a, b))
    out = []
    for s in added:
        if inside.isdisjoint(range(s.start, s.end)):
            inside.update(range(s.start, s.end))
            out.append(s)
    return out


def _score(text: str, kind: str, start: int, end: int, checked: bool, params: PiiParams) -> float:
    words = {w.lower() for w in _near(text, start, end, params.window)}
    score = START[kind] + CHECKED * checked + params.shift * (not words.isdisjoint(_FOR[kind])) - params.shift * (not words.isdisjoint(_AGAINST[kind]))
    return round(min(max(score, 0.0), 1.0), 6)


def _near(text: str, start: int, end: int, window: int) -> Iterator[str]:
    """Words that begin within the window before a span, or within that after it; never parts of words."""
    for m in _WORD.finditer(text, max(0, start - window), start):
        yield m.group()
    for m in _WORD.finditer(text, end, end + window):
        yield _WORD.match(text, m.start(), m.start() + _LONGEST).group()


_SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def find_personal_data(documents: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """(doc_id, spans): by row its spans (kind, start, end in code points with end exclusive, score), by kind and start.

    One row a row of ``documents``, repeated ones included; null ids stay null.  Null and empty texts, and texts
    without personal data, have an empty array.  Texts are read whole.  Extra columns are ignored; an empty table
    gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[s._asdict() for s in spans(t, params)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPAN_TYPE)], ["doc_id", "spans"])

    return small_batches(documents).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, spans {_SPANS}")


def masked(documents: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """``documents`` with each span of its texts replaced by its kind in brackets; where spans overlap, by the first one's."""

    def hide(text: str | None) -> str | None:
        out, at = [], 0
        for s in sorted(spans(text, params), key=lambda s: (s.start, -s.end)):
            if s.start >= at:
                out += [text[at : s.start], f"[{s.kind}]"]
            at = max(at, s.end)
        return text if text is None else "".join([*out, text[at:]])

    place = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(place, batch.schema.field(place), pa.array([hide(t) for t in batch.column(place).to_pylist()], batch.schema.field(place).type))

    return small_batches(documents).mapInArrow(run, documents.schema)


def report(documents: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: base counts, hash of the base spans, all spans as text."""
    found = find_personal_data(documents, params)
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base: Column = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in BASE], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
