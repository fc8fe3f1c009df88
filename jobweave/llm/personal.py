"""Personal data: patterns propose spans, checksums confirm, nearby words adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from jobweave.llm.common import fresh, id_and_text, slices, texts

#: Kinds in the order that settles equal starts; the first four are always kept.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
#: Score before context: what a pattern with its checks is worth alone.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
#: Words that raise the score of a kind when they stand near a span.
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social", "security"),
}
BONUS = 0.35
#: Code points on either side that count as near.
NEAR = 40
#: Spans of the added kinds need this score.
ACCEPT = 0.5

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive and only from the first digit on: a long run of digits is read once.
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}))")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: Characters of an IBAN by country, without blanks.
IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
        21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC",
        33: "RU",
    }.items()
    for country in countries.split()
}
_WORD = re.compile(r"[^\W\d_]+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def mod_97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Found from each @ outwards, which is linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Runs of dotted numbers, taken four at a time."""
    for run in _DOTTED.finditer(text):
        parts, start = run.group().split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            # Leading zeros go first: Python refuses to read very long numbers.
            values = [p.lstrip("0") or "0" for p in four]
            if all(len(v) <= 3 and int(v) <= 255 for v in values):
                yield start, end
            start = end + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m.group())) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Numbers of their country's length; of other countries, up to the last token border where the check holds."""
    done = 0
    for m in _IBAN.finditer(text):
        start, longest = m.span(1)
        if start < done:
            continue
        length = IBAN_LENGTHS.get(text[start : start + 2])
        for end in range(longest, start + 14, -1):
            if text[end - 1] == " " or text[end : end + 1].isascii() and text[end : end + 1].isalnum():
                continue
            number = text[start:end].replace(" ", "")
            if len(number) < 15:
                break
            if length in (None, len(number)) and mod_97(number):
                done = end
                yield start, end
                break


def numbers(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        if m.group()[:3] not in ("000", "666") and m.group()[0] != "9":
            yield m.span()


def score(text: str, kind: str, start: int, end: int) -> float:
    around = text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]
    words = {w.lower() for w in _WORD.findall(around)}
    return min(1.0, PRIOR[kind] + BONUS * bool(words.intersection(CONTEXT[kind])))


_HAS_DIGIT = re.compile("[0-9]")


def spans(text: str) -> list[Span]:
    """All spans of a text, by start and then kind.

    Base kinds are kept whatever their score; the others need ``ACCEPT``.
    """
    found = [("email", *s) for s in emails(text)]
    if _HAS_DIGIT.search(text):
        if "." in text:
            found += [("ip", *s) for s in addresses(text)]
        found += [("card", *s) for s in cards(text)]
        if "+" in text:
            found += [("phone", *s) for s in phones(text)]
        found += [("iban", *s) for s in ibans(text)]
        if "-" in text:
            found += [("ssn", *s) for s in numbers(text)]
    scored = [Span(k, a, b, score(text, k, a, b)) for k, a, b in found]
    kept = [s for s in scored if s.kind in BASE or s.score >= ACCEPT]
    return sorted(kept, key=lambda s: (s.start, KINDS.index(s.kind)))


def redacted(text: str) -> str:
    """The text with each span replaced by its kind in brackets; overlaps become one."""
    found = spans(text)
    if not found:
        return text
    out, done = [], 0
    for s in found:
        if s.end <= done:
            continue
        if s.start >= done:
            out += [text[done : s.start], f"[{s.kind.upper()}]"]
        done = s.end
    return "".join([*out, text[done:]])


_SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id_col, spans) of every row; a span has kind, start, end (code points) and score.

    A null or empty text has no spans. Repeated rows and null ids come back as
    they are; an empty table gives an empty result; other columns are not read.
    """
    span_type = pa.list_(
        pa.struct(
            [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]
        )
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, values in texts(batches):
            found = pa.array([[s._asdict() for s in spans(t)] for t in values], span_type)
            yield pa.RecordBatch.from_arrays([ids, found], ["id", "spans"])

    found = id_and_text(docs, id_col, text_col).mapInArrow(run, f"id bigint, spans {_SPANS}")
    return found.withColumnRenamed("id", id_col)


def joined(items: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """All rows and columns, with the spans of ``text_col`` replaced; a null text stays null.

    ``length_col`` names a column that holds the text's length in code points;
    it follows the new text.
    """
    result = fresh(docs, "redacted")
    types = StructType([*docs.schema.fields, StructField(result, StringType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            clean = [None if t is None else redacted(t) for t in batch.column(at).to_pylist()]
            columns = [*batch.columns, pa.array(clean, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, result])

    new = {text_col: F.col(f"`{result}`")}
    if length_col:
        new[length_col] = F.char_length(new[text_col]).cast(docs.schema[length_col].dataType)
    out = docs.mapInArrow(run, types)
    return out.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
