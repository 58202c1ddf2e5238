"""Texts to token ids with the tokenizers library, each distinct piece of text encoded once.

Both kinds of public vocabulary used here never build a token across certain points of a text, so a
text's ids are the ids of its pieces in order.  Safe points are

* between a character that is no white space and a blank, tab or line end: a pre-token has white
  space only in front, and what its pattern sees behind such a point depends on nothing before;
* behind a run of Latin letters that a mark of punctuation follows: the run is a pre-token there;
* for vocabularies that drop white space, around every blank, tab or line end, which adds no id.

So a text is first cut before every blank, line end, comma and full stop, in a few passes in C, and
what is between is looked up as a whole; only if it is new it is split into pieces.  Texts in which
one of those cuts isn't safe (punctuation before a comma or stop, white space on both sides) go
through the pattern as a whole.

A piece that is one run of Latin letters (with one blank in front, for byte-level vocabularies) is a
single pre-token and goes to the library's model at once; any other piece goes through the whole
library tokenizer.  Bounded memories in two generations, kept as long as the worker process lives,
serve what was seen before: what is used stays when the older generation is dropped.
"""

from __future__ import annotations

import functools
import os
import re
from array import array

import numpy as np

LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Pieces for byte-level vocabularies, which keep white space.
BYTE_PIECES = re.compile(rf" ?[{LATIN}]+(?=[ \t\r\n.,;:!?]|$)|\s*\S+(?:(?=[^ \t\r\n\S])\s+\S*)*|\s+")
#: Pieces for vocabularies that drop white space.
WORD_PIECES = re.compile(rf"[{LATIN}]+(?=[ \t\r\n.,;:!?]|$)|[^ \t\r\n]+")
#: A comma or a full stop that may belong to a pre-token which began before it.
_RUNS_ON = re.compile(rf"[^{LATIN}0-9 \t\r\n][,.]")
_SIMPLE = re.compile(rf" ?[{LATIN}]+")
#: Entries in one generation of the memory of what stands between cuts, for vocabularies that drop
#: white space and for those that keep it; the memory of pieces holds a quarter.
GENERATION, BYTE_GENERATION = 250_000, 600_000


class _Memory(dict):
    """Ids of strings, as little-endian unsigned 32-bit numbers; unknown ones are encoded."""

    def __init__(self, encode, older):
        super().__init__()
        self._encode, self._older = encode, older

    def __missing__(self, piece: str) -> bytes:
        made = self._older.get(piece)
        if made is None:
            made = self._encode(piece)
        self[piece] = made
        return made

    def renewed(self, most: int) -> _Memory:
        """This memory, or an empty one with this as its older generation."""
        if len(self) <= most:
            return self
        self._older = {}
        return _Memory(self._encode, self)


class _Unsafe(Exception):
    """A cut with white space on both sides."""


class Encoder:
    """Encodes texts to ids; ``pieces`` is one of the patterns above."""

    def __init__(self, path: str, pieces: re.Pattern):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self._tokenizer, self._split = Tokenizer.from_file(path), pieces.findall
        self._model = self._tokenizer.model
        self.vocab_size = self._tokenizer.get_vocab_size(with_added_tokens=True)
        spelled, normal = ByteLevel(add_prefix_space=False, use_regex=False), self._tokenizer.normalizer
        letters = [c for c in map(chr, range(256)) if _SIMPLE.fullmatch(c)] + [" "]
        self._letters = {ord(c): spelled.pre_tokenize_str(normal.normalize_str(c) if normal else c)[0][0] for c in letters}
        self._keeps_space = pieces == BYTE_PIECES
        self._pieces, self._parts = _Memory(self._encode, {}), _Memory(self._encode_part, {})

    def _encode(self, piece: str) -> bytes:
        if _SIMPLE.fullmatch(piece):
            ids = [t.id for t in self._model.tokenize(piece.translate(self._letters))]
        else:
            ids = self._tokenizer.encode(piece, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def _encode_pieces(self, text: str) -> bytes:
        return b"".join(map(self._pieces.__getitem__, self._split(text)))

    def _encode_part(self, part: str) -> bytes:
        if not self._keeps_space:
            part = part.strip(" \n")
        elif part[-1:].isspace():
            raise _Unsafe
        return self._encode(part) if _SIMPLE.fullmatch(part) else self._encode_pieces(part)

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids of one text as little-endian unsigned 32-bit numbers, special tokens not added;
        null counts as empty."""
        text = text or ""
        if "\0" in text or _RUNS_ON.search(text):
            out = self._encode_pieces(text)
        else:
            parts = text.replace(" ", "\0 ").replace("\n", "\0\n").replace(",", "\0,").replace(".", "\0.").split("\0")
            try:
                out = b"".join(map(self._parts.__getitem__, parts))
            except _Unsafe:
                out = self._encode_pieces(text)
        most = BYTE_GENERATION if self._keeps_space else GENERATION
        self._pieces, self._parts = self._pieces.renewed(most // 4), self._parts.renewed(most)
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), "<u4")


@functools.cache
def encoder(path: str, pieces: re.Pattern) -> Encoder:
    """One encoder for each vocabulary in a process."""
    return Encoder(path, pieces)
