"""Secret scan: fixed patterns, and dictionary-primed zstandard novelty for what they don't cover.

Base kinds, leftmost and non-overlapping: ``assign`` (a secret's name, a separator and a value of
6 or more characters), ``access`` (AKIA and capitals or digits, 20 or more), ``hex`` (24 or more).

Novelty: a candidate is a run of 16 or more characters of ``[A-Za-z0-9+/_=-]`` that no base span
touches, holding a letter and a digit, that starts within ``REACH`` characters behind a cue of a
sensitive context, in the block of a private key, or at most two characters behind a novel one.  A
run begins behind ``=`` too, and parts of 16 or more that ``=`` divides are candidates of their own, so the
name in NAME=value is not measured with the value.  Its surrounding text, without it, and a dictionary of identifiers and code words prime a zstandard
compressor; what the candidate adds to the compressed size, in bytes, over its length is its
novelty.  Words, paths and identifiers are cheap there, random strings are not: novelty of
``MIN_NOVELTY`` or more is reported as ``novel``.  Whole texts are scanned, in time linear in their
length; the surroundings of one candidate are ``AROUND`` characters on either side.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import zstandard
from pyspark.sql import DataFrame

from quire.llm import spans, storage

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "novel")

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])(?!=)[A-Za-z0-9+/_=-]{16}")
REST = re.compile(r"[A-Za-z0-9+/_=-]*")
PART = re.compile(r"[A-Za-z0-9+/_-]{16,}=*")
DIGIT, LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
CUE = re.compile(r"(?i:passwd|password|passphrase|pwd|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|client[ _-]?key|credential|authorization|bearer|signature|connection[ _-]?string)", re.ASCII)
REACH, AROUND, MIN_NOVELTY = 64, 512, 0.7
#: Characters of a private key's block at most.
BLOCK = 1 << 14

#: Words of code and configuration that make an identifier or a path cheap.
DICTIONARY = " ".join(
    """password passwd passphrase secret token api_key apikey access_key private_key public_key client_id client_secret
    credential authorization bearer basic signature username user email account host hostname localhost port server
    database db_name schema table column index config configuration settings options environment variable value default
    null none true false import from export require include define public private protected static final class struct
    function return const let var string number integer boolean float double array object list dict map set vector
    request response header content type application json xml html text plain utf-8 charset http https www com org net
    example index.html main init setup test tests spec module package version license copyright get set put post delete
    update create select insert where order group by join left right inner outer begin commit rollback transaction
    connection_string endpoint region bucket resource service handler controller manager factory provider listener
    abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 XXXXXXXXXXXXXXXX xxxxxxxxxxxxxxxx
    ---------------- ================ ________________ your_api_key_here changeme placeholder""".split()
).encode()


class Finder:
    """Finds the spans of one text after another; holds the primed compressors."""

    def __init__(self, min_novelty: float = MIN_NOVELTY):
        self.min_novelty = min_novelty

    def novelty(self, before: str, candidate: str, after: str) -> float:
        """Bytes that the candidate adds to its surroundings' compressed size, over its own."""
        around = (before + "\n" + after).encode()
        primed = zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(DICTIONARY + b"\n" + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)
        raw = candidate.encode()
        return (len(primed.compress(raw)) - len(primed.compress(b""))) / len(raw)

    def __call__(self, text: str) -> Iterator[tuple[int, int, str]]:
        taken = []
        if "=" in text or ":" in text:
            taken += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
        if "AKIA" in text:
            taken += [(*m.span(), "access") for m in ACCESS.finditer(text)]
        taken += [(*m.span(), "hex") for m in HEX.finditer(text)]
        yield from taken
        taken.sort()
        begins, reach, done = [s for s, _, _ in taken], list(accumulate((e for _, e, _ in taken), max)), 0
        for cue in CUE.finditer(text):
            at, limit = max(cue.end(), done), cue.end() + REACH
            if text.startswith("-----", cue.end()) and text.rfind("-----BEGIN ", max(0, cue.start() - 40), cue.start()) >= 0:
                limit = max(limit, text.find("-----END", cue.end(), cue.end() + BLOCK))
            while m := CANDIDATE.search(text, at, limit + 16):
                at = done = REST.match(text, m.end()).end()
                parts = [p.span() for p in PART.finditer(text, m.start(), done)] or [(m.start(), done)]
                for start, end in parts:
                    if not (DIGIT.search(text, start, end) and LETTER.search(text, start, end)):
                        continue
                    at_most = bisect_left(begins, end)
                    if at_most and reach[at_most - 1] > start:  # a base span overlaps
                        continue
                    if self.novelty(text[max(0, start - AROUND) : start], text[start:end], text[end : end + AROUND]) >= self.min_novelty:
                        limit = max(limit, end + 2)
                        yield start, end, "novel"


def find_secrets(docs: DataFrame, *, text_col: str = "text", name: str = "secrets") -> DataFrame:
    """``docs`` and their secrets' spans; see ``spans`` for nulls, order and clashing names."""
    return spans.with_spans(docs, Finder, KINDS, text_col=text_col, name=name)


def mask_secrets(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    name = storage.free(docs.columns, "secrets")
    return spans.masked(find_secrets(docs, text_col=text_col, name=name), text_col=text_col, name=name)
