"""Personal data: patterns propose spans, checks confirm them, words nearby move the score.

Positions are code points, ends are exclusive. Every scan is linear in the text: a pattern that
starts with a run of characters is only tried at the head of the run.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctables.llm.common import whole_text

# The kinds in the order in which spans with one start are listed. The first four are
# found by pattern and check alone; the others need the least score.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret")
LEAST_SCORE = 0.5
# Characters before and after a span in which context words are looked for.
CONTEXT = 48

# Score of a confirmed span, and words near it that raise or lower it by a quarter.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.6, "ssn": 0.3, "secret": 0.3}
SUPPORT = {
    "email": "email e-mail mail contact correo courriel",
    "ip": "ip address server host client adresse",
    "card": "card credit visa mastercard debit karte carte tarjeta",
    "phone": "phone tel telephone call mobile fax telefon téléphone teléfono",
    "iban": "iban account bank konto compte cuenta",
    "ssn": "ssn social security insurance taxpayer",
    "secret": "token secret password passwd key apikey api auth authorization bearer credential credentials",
}
AGAINST = {
    "ip": "version release section chapter kapitel",
    "card": "isbn order serial tracking",
    "phone": "isbn order serial",
    "iban": "serial part model",
    "ssn": "part model order serial isbn",
    "secret": "commit checksum digest sha md5 hash revision",
}
# The length of account numbers by country.
IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
    }.items()
    for country in countries.split()
}
# Least bits a sign of a secret.
SECRET_ENTROPY = 3.0

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}")
_IBANS = {n: re.compile(rf"(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}(?: ?[A-Z0-9]{{{(n - 4) % 4}}})?(?![A-Za-z0-9])") for n in set(IBAN_LENGTHS.values())}
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_ANY = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    """Luhn's check: every second digit from the right is doubled."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The check of account numbers: the first four signs go to the end, letters count from 10."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _confirmed(text: str) -> Iterator[tuple[str, int, int]]:
    for start, end in _emails(text):
        yield "email", start, end
    for m in _IP.finditer(text):
        if all(map(_small, m.group().split("."))):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _digits(m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            yield "phone", m.start(), m.end()
    for m in _IBAN_HEAD.finditer(text):
        length = IBAN_LENGTHS.get(m[1])
        rest = _IBANS[length].match(text, m.end()) if length else None
        if rest and len(account := text[m.start() : rest.end()].replace(" ", "")) == length and mod97(account):
            yield "iban", m.start(), rest.end()
    for m in _SSN.finditer(text):
        if m.group()[:3] not in ("000", "666") and m.group()[0] != "9" and m.group()[4:6] != "00" and m.group()[7:] != "0000":
            yield "ssn", m.start(), m.end()
    for m in _SECRET.finditer(text):
        if random_signs(m.group()):
            yield "secret", m.start(), m.end()


def random_signs(run: str) -> bool:
    """Letters and digits, of which none is much more frequent than the others."""
    counts = Counter(run).values()
    entropy = -sum(n / len(run) * math.log2(n / len(run)) for n in counts)
    return entropy >= SECRET_ENTROPY and any(map(str.isdigit, run)) and any(map(str.isalpha, run))


def scored_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of a text, by start and then kind."""
    if not _ANY.search(text):
        return []
    found = []
    for kind, start, end in _confirmed(text):
        near = text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]
        words = set(_WORD.findall(near.lower()))
        score = SCORES[kind]
        score += 0.25 * bool(words & set(SUPPORT[kind].split()))
        score -= 0.25 * bool(words & set(AGAINST.get(kind, "").split()))
        score = round(min(1.0, max(0.0, score)), 2)
        if kind in BASE_KINDS or score >= LEAST_SCORE:
            found.append((kind, start, end, score))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_SPANS = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
)


def spans(text: Column) -> Column:
    """Spans of a text column as an array of (``kind``, ``start``, ``end``, ``score``)."""

    @F.arrow_udf("array<struct<kind:string,start:int,end:int,score:double>>")
    def of(texts: pa.Array) -> pa.Array:
        names = ("kind", "start", "end", "score")
        return pa.array([[dict(zip(names, s)) for s in scored_spans(t.as_py())] for t in texts], _SPANS)

    return of.asNondeterministic()(text)


def find(docs: DataFrame, column: str = "spans") -> DataFrame:
    """Add the spans of every whole text; a column of that name is replaced.

    A null or empty text has an empty list. Spans of the first four kinds are always there, whatever
    their score; the others need ``LEAST_SCORE``, so words nearby decide. Rows are neither added nor dropped; equal texts have
    equal spans; an empty table stays empty. Spans of different kinds may overlap.
    """
    return docs.withColumn(column, spans(whole_text()))


def redacted_text(text: str) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans by the first's."""
    out, done = [], 0
    merged: list[list] = []
    for kind, start, end, _ in scored_spans(text):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        out += [text[done:start], f"[{kind.upper()}]"]
        done = end
    return "".join([*out, text[done:]])


def redact(docs: DataFrame) -> DataFrame:
    """Replace personal data in ``text``; ``n_chars``, where there is one, follows. A null text stays null."""

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([redacted_text(t.as_py()) if t.is_valid else None for t in texts], pa.string())

    out = docs.withColumn("text", of.asNondeterministic()(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
