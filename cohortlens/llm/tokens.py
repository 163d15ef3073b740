"""Token ids of whole texts by a public tokenizer, with a memo of the pieces of its split rule.

The tokenizer's model sees one piece at a time, so a text's ids are the ids of its pieces in order.
A text of Latin letters, digits and marks is split here and its pieces go straight to the model;
any other goes through the whole tokenizer. Ids fit 16 bits for vocabularies of up to 65,536.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np

#: Pieces that the memo holds before it starts anew; about 55 MB a worker.
MEMO = 300_000
#: Longer chunks are not kept.
LONGEST = 64
#: The split rule of word_bpe_49k.json, over Latin letters.
PIECES = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\sa-z0-9ß-öø-ÿ]+")
#: What PIECES holds for: printable ASCII without capitals, blanks, and small Latin-1 letters.
PLAIN = re.compile(r"[\t\n\r -@\[-~ß-öø-ÿ]*")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Pieces(dict):
    """Piece of the split rule -> its ids as little-endian 16-bit bytes; finds what is missing."""

    def __init__(self, model):
        self.tokenize, self.letters = model.tokenize, byte_letters()

    def __missing__(self, piece: str) -> bytes:
        word = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
        tokens = self.tokenize(word)
        ids = struct.pack(f"<{len(tokens)}H", *[x.id for x in tokens])
        if len(piece) <= LONGEST:
            self[piece] = ids
        return ids


class Encoder:
    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        # The shortcut knows this one split rule; other tokenizers go the whole way.
        self.plain = "'s|'t|'re|'ve|'m|'ll|'d|[" in str(self.tokenizer.pre_tokenizer) and "Lowercase" in str(self.tokenizer.normalizer)
        self.pieces = Pieces(self.tokenizer.model)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text as uint16; null gives none."""
        if not text:
            return np.empty(0, "<u2")
        if len(self.pieces) > MEMO:
            self.pieces.clear()
        small = text.lower()
        if self.plain and "<|" not in text and PLAIN.fullmatch(small):
            return np.frombuffer(b"".join(map(self.pieces.__getitem__, PIECES.findall(small))), "<u2")
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2")


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """One encoder a worker, kept from task to task."""
    if (path, special_as_text) not in _ENCODERS:
        _ENCODERS[path, special_as_text] = Encoder(path, special_as_text)
    return _ENCODERS[path, special_as_text]
