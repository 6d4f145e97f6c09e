"""Personal data by anchors: an Aho-Corasick automaton finds at-signs, plus-signs, digits, schemes and cue words in one
pass over a text; local parsers expand each anchor to its whole span and validate it.

The base kinds are those of fixed patterns, leftmost and non-overlapping per kind, so a parser never looks
behind the end of its kind's previous match, valid or not.  The method adds url, secret and account spans, which
overlap base ones freely: a secret is a value of 8 characters or more with a digit after a cue word and a sign; an
account is an IBAN that passes its check (mod 97), a social security number of a valid area, group and serial, or the
digits (6 to 20) after an account's cue word, which must not be part of a longer word.  Cue words are met in any case.

Edge cases: null and empty texts have no spans; offsets are code points; repeated rows and null ids are kept;
other columns are ignored; each text is parsed whole, in time linear in its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import prepare, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "secret", "account")
#: Words that announce a credential or an account; fixed values.
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key", "private_key")
ACCOUNT_CUES = {
    "iban": "iban", "ssn": "ssn", "social security number": "ssn", "social security no": "ssn", "account number": "number", "account no": "number",
    "acct no": "number", "account #": "number", "routing number": "number",
}
_UPPER_LOWER = {c: c + 32 for c in range(65, 91)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_SCHEME = _LETTERS | frozenset("0123456789+.-")
_REST = re.compile(r"[^\s<>\"'`{}|\\^]+")
_VALUE = re.compile(r"[\"']?\s{0,3}(?:[:=]|is\b)\s{0,3}[\"']?([A-Za-z0-9_\-+/=.]{8,})")
_SIGN = re.compile(r"\.?[\"']?\s{0,3}(?:[:=#]|is\b|\b)\s{0,3}[\"']?")
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[ -]?[A-Za-z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}([ -]?)(?!00)[0-9]{2}\1(?!0000)[0-9]{4}(?![0-9])")
_NUMBER = re.compile(r"[0-9](?:[ -]?[0-9]){5,19}(?![0-9])")
_TABLE = str.maketrans("", "", " -().+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d *= 1 + k % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid_iban(text: str) -> bool:
    flat = text.translate(_TABLE).upper()
    return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def iban_end(text: str, at: int) -> int:
    """The end of the longest valid IBAN from at on, cut at its groups' ends, or -1."""
    m = _IBAN.match(text, at)
    while m:
        if valid_iban(m[0]):
            return m.end()
        cut = max(m[0].rfind(" "), m[0].rfind("-"))
        m = _IBAN.fullmatch(text, at, at + cut) if cut > 0 else None
    return -1


def account_end(what: str, text: str, at: int) -> int:
    if what == "iban":
        return iban_end(text, at)
    m = (_SSN if what == "ssn" else _NUMBER).match(text, at)
    return m.end() if m else -1


def lowered(text: str) -> str:
    """Lower case of equal length."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_UPPER_LOWER)


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    for word, what in (("@", "email"), ("+", "phone"), ("://", "url")):
        a.add_word(word, (what, len(word)))
    for cue in SECRET_CUES:
        a.add_word(cue, ("secret", len(cue)))
    for cue, what in ACCOUNT_CUES.items():
        a.add_word(cue, (what, len(cue)))
    a.make_automaton()
    return a


def find(text: str, machine: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans, by start and then kind."""
    spans, ends, run_end = [], [0] * len(KINDS), 0
    for last, (what, size) in machine.iter(lowered(text)):
        at = last - size + 1
        if what == "digit":
            if at >= run_end:  # the first digit of a run
                run_end = _DIGITS.match(text, at).end()
                if at >= ends[1] and (m := _IP.match(text, at)):
                    ends[1] = m.end()
                    if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")):
                        spans.append((at, 1, m.end()))
            if at >= ends[2] and (m := _CARD.match(text, at)):
                ends[2] = m.end()
                digits = m[0].translate(_TABLE)
                if 14 <= len(digits) <= 19 and luhn(digits):
                    spans.append((at, 2, m.end()))
        elif what == "email":
            start = at
            while start > ends[0] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                ends[0] = m.end()
                spans.append((start, 0, m.end()))
        elif what == "phone":
            if at >= ends[3] and (m := _PHONE.match(text, at)):
                ends[3] = m.end()
                if 10 <= len(m[0].translate(_TABLE)) <= 15:
                    spans.append((at, 3, m.end()))
        elif what == "url":
            start = at
            while start > ends[4] and text[start - 1] in _SCHEME:
                start -= 1
            while start < at and text[start] not in _LETTERS:
                start += 1
            if start < at and (r := _REST.match(text, at + 3)):
                end = at + 3 + len(r[0].rstrip(".,;:!?)]"))
                if end > at + 3:
                    ends[4] = end
                    spans.append((start, 4, end))
        elif what == "secret":
            if at >= ends[5] and (m := _VALUE.match(text, last + 1)):
                value = m[1].rstrip(".-/=") or m[1]
                if len(value) >= 8 and any(c.isdigit() for c in value):
                    ends[5] = m.start(1) + len(value)
                    spans.append((m.start(1), 5, ends[5]))
        elif at >= ends[6] and not (at and text[at - 1].isalnum()) and not text[last + 1 : last + 2].isalpha():
            start = _SIGN.match(text, last + 1)
            start = start.end() if start else last + 1
            if (end := account_end(what, text, start)) > 0:
                ends[6] = end
                spans.append((start, 6, end))
    return sorted(spans)


def join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for b in batches:
            found = [find(t.as_py() or "", machine) for t in b.column(1)]
            counts = [pa.array([sum(k == kind for _, k, _ in f) for f in found], pa.int64()) for kind in range(len(BASE))]
            digest = [hashlib.sha256(join([x for x in f if x[1] < len(BASE)]).encode()).hexdigest() for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(digest, pa.string()), pa.array(map(join, found), pa.string())], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string")


def op4_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
