"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words adjust a score.

Kinds: email, ip, card (Luhn), phone, and iban (ISO 7064 mod-97). The first four are kept whatever their
score; an iban needs both its checksum and the minimum score. Spans are in code points, end exclusive,
ordered by start and then by the order of KINDS; spans of different kinds may overlap.

Edge cases: a null text counts as empty and has no spans; null ids and repeated rows pass through row by
row; very long texts cost time in proportion to their length (no pattern here backtracks beyond a run of
its own characters); columns other than the id and the text are left out of find_pii and kept by redact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, map_rows, text_or_empty

KINDS = ("email", "ip", "card", "phone", "iban")
BASE_KINDS = KINDS[:4]

#: Score of a confirmed span before its context is read, and what a context word adds or takes away.
BASE_SCORE = {"email": 0.6, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.7}
CONTEXT_STEP = 0.2
CONTEXT_CHARS = 48
CONTEXT_WORDS = {
    "email": {"email", "mail", "contact", "write", "address", "correo", "courriel"},
    "ip": {"ip", "host", "server", "address", "client", "login"},
    "card": {"card", "credit", "visa", "mastercard", "payment", "pan", "tarjeta", "carte", "karte"},
    "phone": {"phone", "call", "tel", "mobile", "fax", "telefon", "teléfono", "téléphone"},
    "iban": {"iban", "account", "bank", "transfer", "konto", "compte", "cuenta"},
}
AGAINST_WORDS = {
    "email": {"noreply", "placeholder"},
    "ip": {"version", "release", "build", "section"},
    "card": {"isbn", "order", "tracking", "serial", "sku"},
    "phone": {"isbn", "order", "serial"},
    "iban": {"serial", "sku", "part"},
}
MIN_SCORE = 0.5

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The look-behind changes no match: a run of digits that fails at its start fails at every later digit.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WORDS = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(code: str) -> bool:
    """ISO 7064 check of an IBAN without spaces."""
    moved = code[4:] + code[:4]
    return int("".join(str(int(ch, 36)) for ch in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        left = text[free:at]
        start = free + len(left.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        else:
            # No local part reaches past this sign, so what lies before it is done with.
            free = at + 1
        at = text.find("@", free)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        code = m[0]
        while len(code.replace(" ", "")) >= 15:
            if mod97(code.replace(" ", "")):
                yield m.start(), m.start() + len(code)
                break
            code = code.rpartition(" ")[0]


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]
    words = set(_WORDS.findall(near.lower()))
    score = BASE_SCORE[kind]
    score += CONTEXT_STEP * bool(words & CONTEXT_WORDS[kind]) - CONTEXT_STEP * 2 * bool(words & AGAINST_WORDS[kind])
    return round(min(1.0, max(0.0, score)), 3)


def spans_of(text: str, min_score: float = MIN_SCORE) -> list[tuple[str, int, int, float]]:
    """All spans of one text as (kind, start, end, score)."""
    found = [("email", *s) for s in _emails(text)]
    found += [("ip", *s) for s in _ips(text)]
    found += [("card", *s) for s in _cards(text)]
    if "+" in text:
        found += [("phone", *s) for s in _phones(text)]
    found += [("iban", *s) for s in _ibans(text)]
    found.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    scored = [(k, a, b, _score(text, k, a, b)) for k, a, b in found]
    return [x for x in scored if x[0] in BASE_KINDS or x[3] >= min_score]


def mask(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one mark of the first kind."""
    out, done = [], 0
    for kind, start, end, _ in spans:
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


_SPANS = "spans array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """(id, spans) for each row."""

    def make():
        def one(row):
            return row[0], [{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in spans_of(row[1], min_score)]

        return one

    narrow = docs.select(F.col(id_col).cast("bigint").alias(id_col), text_or_empty(text_col).alias("text"))
    return map_rows(narrow, make, f"{id_col} bigint, {_SPANS}")


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", min_score: float = MIN_SCORE) -> DataFrame:
    """All rows and columns with personal data masked in the text (a null text stays null); a column of
    the text's length, where there is one, follows the new text."""

    bound_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        return pa.array([None if (t := x.as_py()) is None else mask(t, spans_of(t, min_score)) for x in texts], pa.string())

    out = docs.withColumn(text_col, masked(F.col(text_col)))
    if chars_col in docs.columns:
        kind = docs.schema[chars_col].dataType
        out = out.withColumn(chars_col, F.coalesce(F.char_length(F.col(text_col)).cast(kind), F.col(chars_col)))
    return out
