"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors in a text: at-signs, plus signs, digits, scheme marks and cue words. At each
anchor a local parser expands to the boundaries and validates. No parser starts inside what its kind has taken, so spans
of a kind never overlap and the base kinds find what their patterns find from left to right:

email  name, at-sign, dotted domain          ip     four dotted numbers of at most 255
card   12 to 19 digits that pass Luhn        phone  plus sign, 9 to 15 digits with separators

Added by the method: secret (values after a password, token or key cue, access key ids), account (IBAN after its cue with
valid check digits, at its country's length; social security numbers and account numbers after theirs), login
(user:password before the host of an address).

Cues are found in any case, those of several words with a space, hyphen, underscore or nothing between. Secrets and
logins have no greatest length: they reach to the first delimiter.

Positions are code points, ends exclusive. Null text counts as empty and has no spans; null or repeated doc_ids are
searched row by row; an empty table gives no rows; extra columns are ignored by ``find_all`` and kept by ``mask``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import slices, texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "account", "login")
# Cues in lower case.
CUES = ("password", "passwd", "pwd", "passphrase", "token", "secret", "api key", "access key", "secret key", "private key", "client secret", "credential")
IBANS = ("iban",)
SSNS = ("ssn", "social security number", "social security no", "social security")
ACCOUNTS = ("account no", "account number", "account #", "acct no", "acct #", "account nr")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ACCESS_KEY = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])")
SET = re.compile(r"[\"']? {0,3}[=:] {0,3}[\"']?")
VALUE = re.compile(r"[^\s\"',;]{8,}+")
IBAN = re.compile(r"[ :.#=]{0,3}([A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30})(?![A-Za-z0-9])")
SSN = re.compile(r"[ :.#=]{0,3}([0-9]{3}[- ]?[0-9]{2}[- ]?[0-9]{4})(?![0-9])")
ACCOUNT = re.compile(r"[ :.#=]{0,3}([0-9](?:[ -]?[0-9]){5,16})(?![0-9])")
LOGIN = re.compile(r"([^\s/?#@:]++:[^\s/?#@]++)@")

#: Characters of an IBAN by its country.
IBAN_SIZES = {
    c[:2]: int(c[2:])
    for c in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 "
        "GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 "
        "PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
    ).split()
}

FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

#: Start, kind's place in KINDS, end.
Span = tuple[int, int, int]


@lru_cache(1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
    for mark, name in (("@", "at"), ("+", "plus"), ("://", "scheme"), ("akia", "key")):
        found.add_word(mark, (name, len(mark)))
    for cues, name in ((CUES, "cue"), (IBANS, "iban"), (SSNS, "ssn"), (ACCOUNTS, "account")):
        for cue in cues:
            first, *others = cue.split(" ")
            for between in product((" ", "-", "_", ""), repeat=len(others)):
                form = first + "".join(map(str.__add__, between, others))
                found.add_word(form, (name, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def iban_valid(number: str) -> bool:
    moved = number[4:] + number[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def iban_size(run: str) -> int:
    """How much of a run of words is a valid IBAN: the words of its country's length, as many as are valid for a country
    that isn't listed; or 0."""
    size = IBAN_SIZES.get(run[:2].upper())
    for k in range(len(run), 0, -1):
        if k == len(run) or run[k] == " ":
            number = run[:k].replace(" ", "")
            if (len(number) == size if size else len(number) >= 15) and iban_valid(number):
                return k
    return 0


def find(text: str) -> list[Span]:
    """All spans of a text in order of start, then kind."""
    spans: list[Span] = []
    email_done = ip_done = card_done = phone_done = value_done = 0
    last_digit = -1
    # Only ASCII letters are lower-cased, so places stay.
    for last, (what, size) in automaton().iter(text.encode().lower().decode()):
        at = last + 1 - size
        if what == "digit":
            if at >= card_done:
                m = CARD.match(text, at)
                card_done = m.end() if m else at + 1
                if m:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        spans.append((at, 2, card_done))
            if at >= ip_done:
                m = DOTTED.match(text, at)
                parts = m[0].split(".")
                ip_done = m.end()
                if len(parts) >= 4:
                    ip_done = at + len(".".join(parts[:4]))
                    if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in parts[:4]):
                        spans.append((at, 1, ip_done))
        elif what == "at":
            start = at
            while start > email_done and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                email_done = m.end()
                spans.append((start, 0, email_done))
        elif what == "plus":
            if at >= phone_done and (m := PHONE.match(text, at)):
                phone_done = m.end()
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    spans.append((at, 3, phone_done))
        elif what == "cue":
            if m := SET.match(text, last + 1):
                start = m.end()
                # A cue inside a value shares its end, so no value is scanned twice.
                if start >= value_done and (m := VALUE.match(text, start)):
                    value_done = m.end()
                    last_digit = next((k for k in range(value_done - 1, start - 1, -1) if text[k].isdigit()), -1)
                if start + 8 <= value_done and start <= last_digit:
                    spans.append((start, 4, value_done))
        elif what == "key":
            if (at == 0 or not text[at - 1].isalnum()) and (m := ACCESS_KEY.match(text, at)):
                spans.append((at, 4, m.end()))
        elif what == "iban":
            if (m := IBAN.match(text, last + 1)) and (n := iban_size(m[1])):
                spans.append((m.start(1), 5, m.start(1) + n))
        elif what == "ssn":
            if m := SSN.match(text, last + 1):
                spans.append((m.start(1), 5, m.end(1)))
        elif what == "account":
            if m := ACCOUNT.match(text, last + 1):
                spans.append((m.start(1), 5, m.end(1)))
        elif m := LOGIN.match(text, last + 1):
            spans.append((m.start(1), 6, m.end(1)))
    return sorted(set(spans))


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one, of the first's kind."""
    out, done = [], 0
    for start, kind, end in spans:
        if start >= done:
            out += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def find_all(docs: DataFrame) -> DataFrame:
    """Counts and spans of every row; columns of FOUND."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for text in texts(part):
                    spans = find(text)
                    base = [s for s in spans if s[1] < len(BASE)]
                    kinds = [s[1] for s in base]
                    out.append((*map(kinds.count, range(len(BASE))), hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
                columns = [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 4 + [pa.string()] * 2)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], [c.split()[0] for c in FOUND.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, FOUND)


def mask(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced by its kind, and n_chars, where there is one, counted anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                clean = [None if t is None else masked(t, s) if (s := find(t)) else t for t in part.column("text").to_pylist()]
                part = part.set_column(part.schema.get_field_index("text"), "text", pa.array(clean, pa.string()))
                if (k := part.schema.get_field_index("n_chars")) >= 0:
                    counts = pa.array([None if t is None else len(t) for t in clean], pa.int64())
                    part = part.set_column(k, "n_chars", counts.cast(part.schema.field(k).type))
                yield part

    return docs.mapInArrow(run, docs.schema)
