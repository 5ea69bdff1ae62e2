"""Personal data in whole texts by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, schemes, plus signs, digits, and the words that introduce
an account number. From each anchor a small parser walks left and right to the boundaries of a candidate and
checks it, so no pattern is tried at every position of a text.

Kinds of the base, always found and never overlapping within a kind: ``email``, ``ip``, ``card`` (13 to 19 digits
with a right check digit) and ``phone``. Kinds that the anchors add: ``login`` (the user and password part of an
address with a scheme), ``iban`` (right check number) and ``account`` (digits after a word such as "account").
Added spans that overlap a span of the base are dropped.

Edge cases: a null or empty text has no spans and keeps its value; equal rows give equal results; a
clashing name of a result column gets a number; offsets count code points, the end is exclusive.
"""

from __future__ import annotations

import hashlib
import string
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.llm.common import fresh, map_arrow, slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban", "account")
# Characters of the parts of the base kinds.
_DIGITS = frozenset("0123456789")
_DOMAIN = frozenset(string.ascii_letters + string.digits + "-")
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_PHONE = frozenset(" ().-0123456789")
_IBAN = frozenset(string.ascii_uppercase + string.digits)
_LOGIN = frozenset(string.ascii_letters + string.digits + "._~%!$&'*+,;=-")
_SCHEMES = ("http://", "https://", "ftp://", "ssh://", "git://", "postgres://", "mysql://", "redis://")
_ACCOUNT_WORDS = tuple(form for word in ("account", "acct", "konto", "compte", "cuenta") for form in (word, word.title(), word.upper()))
# Words that may stand between an account's cue and its digits, in any case.
_NUMBER_WORDS = frozenset(("no", "nr", "nro", "num", "number"))

Span = tuple[int, int]


def _run(text: str, at: int, allowed: frozenset[str]) -> int:
    """The end of the run of allowed characters that starts at ``at``."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def _email(text: str, at: int, floor: int) -> Span | None:
    """The address around the at-sign at ``at``; it may not begin before ``floor``."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    end = _run(text, at + 1, _DOMAIN)
    if start == at or end == at + 1:
        return None
    labels = 0
    while end < len(text) and text[end] == "." and (after := _run(text, end + 1, _DOMAIN)) > end + 1:
        end, labels = after, labels + 1
    return (start, end) if labels else None


def _dotted(text: str, first: int) -> list[Span]:
    """The runs of digits joined by single dots, of which the first starts at ``first``."""
    runs = [(first, _run(text, first, _DIGITS))]
    while (dot := runs[-1][1]) < len(text) and text[dot] == "." and (end := _run(text, dot + 1, _DIGITS)) > dot + 1:
        runs.append((dot + 1, end))
    return runs


def _spaced_digits(text: str, first: int) -> int:
    """The end of the digits from ``first`` on that are joined directly or by one space or hyphen."""
    end, n = first + 1, len(text)
    while end < n:
        if text[end] in _DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in _DIGITS:
            end += 2
        else:
            break
    return end


def luhn(digits: str) -> bool:
    """Whether the last digit is the right check digit."""
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _digits(text: str, span: Span) -> str:
    return "".join(c for c in text[span[0]:span[1]] if c in _DIGITS)


def _phone(text: str, plus: int) -> Span | None:
    """A plus, a digit, and at least one more sign before the last digit of the run."""
    if plus + 1 >= len(text) or text[plus + 1] not in _DIGITS:
        return None
    end = _run(text, plus + 2, _PHONE)
    while end > plus + 3 and text[end - 1] not in _DIGITS:
        end -= 1
    return (plus, end) if end > plus + 3 and text[end - 1] in _DIGITS else None


def _iban(text: str, first: int) -> Span | None:
    """An account number whose two check digits start at ``first``; groups may be parted by single spaces."""
    start = first - 2
    if start < 0 or not (text[start:first].isascii() and text[start:first].isalpha() and text[start:first].isupper()):
        return None
    if start and (text[start - 1].isalnum() or text[start - 1] == "_") or _run(text, first, _DIGITS) < first + 2:
        return None
    end, kept = start, []
    while end < len(text) and len(kept) < 34:
        if text[end] in _IBAN:
            kept.append(text[end])
        elif not (text[end] == " " and len(kept) % 4 == 0 and end + 1 < len(text) and text[end + 1] in _IBAN):
            break
        end += 1
    # Words in capitals may follow a number; the longest part with a right check number counts.
    while len(kept) >= 15:
        if text[end - 1] != " " and (end == len(text) or not text[end].isalnum()):
            moved = "".join(kept[4:] + kept[:4])
            if int("".join(str(int(c, 36)) for c in moved)) % 97 == 1:
                return start, end
        end -= 1
        if text[end] != " ":
            kept.pop()
    return None


def _login(text: str, host: int) -> Span | None:
    """``user:password`` between the scheme's end at ``host`` and an at-sign."""
    user = _run(text, host, _LOGIN)
    if user == host or user >= len(text) or text[user] != ":":
        return None
    end = _run(text, user + 1, _LOGIN)
    return (host, end) if end > user + 1 and end < len(text) and text[end] == "@" else None


def _account(text: str, after: int) -> Span | None:
    """6 to 18 digits that follow the word at most eight signs later, on its line.

    Between them there may be one of a few words for a number, apart from the cue, and no other letters.
    """
    at = after
    while at < len(text) and at < after + 8 and text[at] not in _DIGITS:
        if text[at] == "\n":
            return None
        if text[at].isalpha():
            end = at
            while end < len(text) and text[end].isalpha():
                end += 1
            if at == after or text[at:end].lower() not in _NUMBER_WORDS:
                return None
            at = end
        else:
            at += 1
    end = _run(text, at, _DIGITS)
    return (at, end) if 6 <= end - at <= 18 and not (end < len(text) and text[end].isalpha()) else None


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in [("@", "@"), ("+", "+"), *((d, "0") for d in _DIGITS), *((s, "://") for s in _SCHEMES),
                       *((w, "account") for w in _ACCOUNT_WORDS)]:
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def spans(text: str | None) -> dict[str, list[Span]]:
    """The spans of a text by kind, in the order of their starts."""
    found: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    if not text:
        return found
    # Ends of what each kind has used up, valid or not: matches do not overlap and are not tried again.
    used = dict.fromkeys(KINDS, 0)
    for last, (anchor, length) in _anchors().iter(text):
        at = last - length + 1
        if anchor == "@":
            if span := _email(text, at, used["email"]):
                found["email"].append(span)
                used["email"] = span[1]
        elif anchor == "+":
            if at >= used["phone"] and (span := _phone(text, at)):
                used["phone"] = span[1]
                if 9 <= len(_digits(text, span)) <= 15:
                    found["phone"].append(span)
        elif anchor == "0":
            if at >= used["ip"] and (at == 0 or text[at - 1] not in _DIGITS or at == used["ip"]):
                runs = _dotted(text, at)
                # A chain is used up in fours; what is left over of it cannot match.
                for k in range(0, len(runs) - 3, 4):
                    if all(_small(text[a:b]) for a, b in runs[k:k + 4]):
                        found["ip"].append((runs[k][0], runs[k + 3][1]))
                used["ip"] = runs[-1][1]
            if at >= used["card"]:
                end = _spaced_digits(text, at)
                used["card"] = end
                if 13 <= len(digits := _digits(text, (at, end))) <= 19 and luhn(digits):
                    found["card"].append((at, end))
            if at >= used["iban"] and (span := _iban(text, at)):
                found["iban"].append(span)
                used["iban"] = span[1]
        elif anchor == "://":
            if span := _login(text, last + 1):
                found["login"].append(span)
        elif at >= used["account"] and (span := _account(text, last + 1)):
            found["account"].append(span)
            used["account"] = span[1]
    base = sorted(span for kind in BASE for span in found[kind])
    starts = [start for start, _ in base]
    # How far the spans up to each one reach.
    reach = list(accumulate((end for _, end in base), max))

    def free(start: int, end: int) -> bool:
        before = bisect_left(starts, end)
        return not before or reach[before - 1] <= start

    for kind in KINDS[len(BASE):]:
        found[kind] = [span for span in found[kind] if free(*span)]
    return found


def _small(digits: str) -> bool:
    """At most 255, with any number of leading zeros."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def joined(found: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in kinds for a, b in found[kind])


def redacted(text: str | None, found: dict[str, list[Span]]) -> str | None:
    """The text with a placeholder such as ``<EMAIL>`` for every span; overlapping spans become one."""
    if not text:
        return text
    out, at, last = [], 0, -1
    for start, end, kind in sorted((a, b, kind) for kind in KINDS for a, b in found[kind]):
        if start >= last:
            out += [text[at:start], f"<{kind.upper()}>"]
        last = at = max(last, end)
    return "".join([*out, text[at:]])


RESULT = T.StructType([
    *[T.StructField(f"n_{kind}", T.LongType()) for kind in BASE],
    T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
    T.StructField("redacted", T.StringType()),
])
_ARROW = pa.struct([*[(f"n_{kind}", pa.int64()) for kind in BASE], ("base_sha256", pa.string()),
                    ("spans", pa.string()), ("redacted", pa.string())])


def find(docs: DataFrame, text: str = "text", out: str = "pii", payload: list[str] | None = None,
         redaction: bool = True) -> DataFrame:
    """``docs`` with a struct column: counts and digest of the base spans, all spans, and the redacted text.

    ``payload`` names the columns to carry (default: all); without ``redaction`` that field is null.
    """
    names = docs.columns if payload is None else payload
    out = fresh([*names, text], out)
    schema = T.StructType([*[docs.schema[name] for name in names], T.StructField(out, RESULT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, text)):
            rows = []
            for value in batch.column(text).to_pylist():
                found = spans(value)
                rows.append({f"n_{kind}": len(found[kind]) for kind in BASE} | {
                    "base_sha256": hashlib.sha256(joined(found, BASE).encode()).hexdigest(),
                    "spans": joined(found, KINDS), "redacted": redacted(value, found) if redaction else None})
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(name) for name in names], pa.array(rows, _ARROW)], [*names, out])

    return map_arrow(docs.select(*names, *([] if text in names else [text])), run, schema)


def redact(docs: DataFrame, text: str = "text", size: str | None = "n_chars") -> DataFrame:
    """``docs`` with the spans replaced in the text, and the number of characters, if there is such a column, updated."""
    out = fresh(docs.columns, "pii")
    found = find(docs, text, out)
    cleaned = F.col(out)["redacted"]
    return found.select(*[
        cleaned.alias(name) if name == text
        else F.when(F.col(out)["spans"] == "", F.col(name)).otherwise(F.length(cleaned)).cast(kind).alias(name)
        if name == size else F.col(name)
        for name, kind in docs.dtypes])


def report(docs: DataFrame) -> DataFrame:
    """Per document the counts, the digest and the spans, without the text."""
    found = find(docs, payload=["doc_id"], redaction=False)
    return found.select("doc_id", *[
        F.col("pii")[name].alias(name) for name in (*[f"n_{kind}" for kind in BASE], "base_sha256", "spans")])
