"""Token ids of whole texts with a tokenizers file: every distinct piece of a text is encoded once per task.

A text is cut where no token can cross: before a space that follows a character which is not white space,
and, in ordinary texts, around commas, full stops and line ends. Where the tokenizer itself drops white space
and case, ordinary texts are cut at all white space and lower-cased first, so more pieces are alike. The library
encodes the pieces it has not seen, the ids of the others come from a bounded table, and the ids of a text are
those of its pieces in order.
"""

from __future__ import annotations

import json
import os
import re
from array import array

from tokenizers import Tokenizer

# Before a space after anything that is not white space.
CUT = re.compile(r"(?<=\S)(?= )")
# What makes a text unusual: punctuation in a row, rare white space, white space in a row or before a comma or
# full stop. Patterns of one character class and plain substrings are what is searched fastest.
IN_A_ROW = re.compile(r"[^\w\s]{2}")
JOINED = re.compile(r"[,.](?<=[^\w\s].)")  # a comma or full stop that one token may hold with the sign before it
RARE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000_\0]")
PAIRS = ("  ", " \n", "\n ", "\n\n", " ,", " .", "\n,", "\n.")
# Where white space and case do not count: characters whose lower case or composition needs its context.
RARE_FOLDED = re.compile("[_\0\x1c-\x1f\u0130\u0250-\U0010ffff]")
# How byte-level tokenizers write bytes: printable Latin-1 signs as they are, the others from U+0100 on in order.
PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
SIGNS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PLAIN)}

SPACE = chr(SIGNS[32])


class Encoder(dict):
    """Ids of texts as little-endian unsigned 32-bit bytes; strings of special tokens get their ids, as in the library.

    The dictionary holds the ids of pieces; what it lacks is learned when it is asked for. Up to ``most`` pieces
    are remembered, and as many older ones that are taken over when they occur again.
    """

    def __init__(self, path: str, most: int = 600_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs side by side
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        # Words alone count: case is folded, and the pattern that makes words keeps no white space.
        self.folds = "Lowercase" in json.dumps(spec["normalizer"]) and "Removed" in json.dumps(spec["pre_tokenizer"])
        self.most = most
        self.older: dict[str, bytes] = {}
        self.model = self.tokenizer.model.tokenize

    def pieces(self, text: str) -> list[str]:
        if self.folds:
            if RARE_FOLDED.search(text) or IN_A_ROW.search(text):
                return CUT.split(text)
            return text.lower().replace(",", " , ").replace(".", " . ").split()
        if RARE.search(text) or JOINED.search(text) or any(p in text for p in PAIRS):
            return CUT.split(text)
        return text.replace(" ", "\0 ").replace(",", "\0,").replace(".", "\0.").replace("\n", "\0\n\0").split("\0")

    def encode(self, text: str) -> bytes:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, self.pieces(text)))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of several texts."""
        return [self.encode(t) for t in texts]

    def __missing__(self, piece: str) -> bytes:
        """Ids of a new piece, from the older table or by the library.

        A piece of letters alone is one word to the tokenizer, whose model can be asked directly.
        """
        ids = self.older.get(piece)
        if ids is None:
            word = piece[1:] if piece[:1] == " " else piece
            if not word.isalpha() or self.folds and (word != word.lower() or RARE_FOLDED.search(word)):
                found = self.tokenizer.encode_batch_fast([piece], add_special_tokens=False)[0].ids
            else:
                signs = word if self.folds else piece
                if not signs.isascii():
                    signs = signs.encode().decode("latin-1").translate(SIGNS)
                found = [t.id for t in self.model(signs.replace(" ", SPACE))]
            ids = array("I", found).tobytes()
        self[piece] = ids
        return ids


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of this Python worker: the file is read and pieces are learned once for all its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
