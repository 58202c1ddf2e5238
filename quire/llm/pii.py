"""Personal data by anchor expansion.

An Aho-Corasick automaton passes over each whole text once and finds anchors: at-signs, digits,
plus signs, URI schemes and identifier cues.  At each anchor a local parser expands to the left and
right, checks what it has and gives a span.

Base kinds, leftmost and non-overlapping within a kind, matches that fail their check dropped and
passed over: ``email``; ``ip`` (four parts, at most 255 each); ``card`` (12 to 19 digits passing
Luhn); ``phone`` (+ and 9 to 15 digits).  Further kinds: ``userinfo`` (name and password in a
URI), ``iban`` (check digits hold), ``account`` (a cue, then 8 to 17 digits) and ``ssn`` (a cue,
then ddd-dd-dddd with no group of zeros).  Whole texts are scanned, in time linear in their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
from pyspark.sql import DataFrame

from quire.llm import spans, storage

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "userinfo", "iban", "account", "ssn")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
USERINFO = re.compile(r"://([^\s/@:]+:[^\s/@]+)@[A-Za-z0-9]")
CUES = ("iban", "account", "acct", "konto", "compte", "cuenta", "ssn", "social security")
AFTER_CUE = r"\x20*+(?:number|no\.?|nr\.?|num\.?|#)?+\x20*+[:=#]?+\x20*+"  # never tried anew, so long blanks cost once
IBAN = re.compile(AFTER_CUE + r"([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
ACCOUNT = re.compile(AFTER_CUE + r"([0-9]{8,17})(?![0-9])")
SSN = re.compile(AFTER_CUE + r"([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])")
_LOWER = {i: i + 32 for i in range(65, 91)}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def iban_holds(text: str) -> bool:
    raw = text.replace(" ", "")
    return 15 <= len(raw) <= 34 and int("".join(str(int(c, 36)) for c in raw[4:] + raw[:4])) % 97 == 1


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


class Finder:
    def __init__(self):
        self.anchors = ahocorasick.Automaton()
        for anchor in ["@", "+", "://", *"0123456789", *CUES]:
            self.anchors.add_word(anchor, anchor)
        self.anchors.make_automaton()

    def __call__(self, text: str) -> Iterator[tuple[int, int, str]]:
        lower = text.translate(_LOWER) if not text.islower() else text
        email = ip = card = phone = run = 0  # where each kind, and the last run of digits, ended
        for last, anchor in self.anchors.iter(lower):
            at = last + 1 - len(anchor)
            if anchor.isdigit():
                if at >= card and (m := CARD.match(text, at)):
                    card = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        yield at, card, "card"
                if at >= run:
                    run = DIGITS.match(text, at).end()
                    if at >= ip and (m := IP.match(text, at)):
                        ip = m.end()
                        if all(map(_small, m.groups())):
                            yield at, ip, "ip"
            elif anchor == "@":
                start = at
                while start > email and text[start - 1] in LOCAL:
                    start -= 1
                if start < at and (m := DOMAIN.match(text, at + 1)):
                    email = m.end()
                    yield start, email, "email"
            elif anchor == "+":
                if at >= phone and (m := PHONE.match(text, at)):
                    phone = m.end()
                    if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                        yield at, phone, "phone"
            elif anchor == "://":
                if m := USERINFO.match(text, at):
                    yield *m.span(1), "userinfo"
            else:
                if (m := IBAN.match(text, last + 1)) and iban_holds(m[1]):
                    yield *m.span(1), "iban"
                elif m := ACCOUNT.match(text, last + 1):
                    yield *m.span(1), "account"
                elif (m := SSN.match(text, last + 1)) and not re.search(r"000-|-00-|-0000", m[1]):
                    yield *m.span(1), "ssn"


def find_pii(docs: DataFrame, *, text_col: str = "text", name: str = "pii") -> DataFrame:
    """``docs`` and the spans of personal data; see ``spans`` for nulls, order and clashing names."""
    return spans.with_spans(docs, Finder, KINDS, text_col=text_col, name=name)


def mask_pii(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    name = storage.free(docs.columns, "pii")
    return spans.masked(find_pii(docs, text_col=text_col, name=name), text_col=text_col, name=name)
