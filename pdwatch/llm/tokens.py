"""Token ids of whole texts, with the pieces between spaces encoded once per worker.

Byte-level and word BPE never merge across a space that has no other white space beside it, so a
text is the concatenation of its pieces and the ids of a piece do not depend on its neighbours.
Pieces are looked up in a table of a fixed number of entries; only new ones reach the tokenizer.
"""

from __future__ import annotations

import re
from array import array
from codecs import charmap_decode
from collections.abc import Callable
from operator import attrgetter

import numpy as np

from pdwatch.llm.common import single_threaded

#: Entries that a worker's table takes before it lets the older ones go, which changes no result. It holds twice as many at most.
#: A dictionary grows beyond two thirds of a power of two, so this is the most that the space for 2^18 entries takes.
CACHE_ENTRIES = (1 << 19) * 2 // 3
#: Longer pieces are encoded anew each time.
CACHED_LENGTH = 48

_TWO_SPACES = re.compile(r"\s\s")
_SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
#: How the two tokenizers cut a piece into words, for the characters in _PLAIN.
_PLAIN = re.compile(r" ?[\x21-\x7eÀ-ÿ]*")
#: Letters alone are one word for both, so most pieces need not be cut.
_LETTERS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
_WORDS_WITH_SPACE = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+"
    r"| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+| "
)
_BARE_WORDS = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]"
    r"|[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+"
)
#: Byte-level vocabularies write a byte that is not printable Latin as the next character from 256 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARACTER = {byte: 256 + n for n, byte in enumerate(b for b in range(256) if b not in set(_PRINTABLE))}
_BYTE_CHARACTERS = "".join(chr(_BYTE_CHARACTER.get(byte, byte)) for byte in range(256))
_id_of = attrgetter("id")

_encoders: dict[tuple[str, bool], PieceEncoder] = {}


def spaced_pieces(text: str) -> list[str]:
    """Pieces that keep the space before them: for tokenizers that encode white space."""
    # White space and zero bytes are not printable, spaces are: most texts need no search by character class.
    flat = text.replace("\n", " ")
    if ("  " in flat or not flat.isprintable()) and ("\0" in text or _TWO_SPACES.search(text)):
        return _SAFE_CUT.split(text)
    return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")


def bare_pieces(text: str) -> list[str]:
    """Pieces between spaces: for tokenizers that lower the case and drop white space."""
    return text.replace("\n", " ").split(" ")


class Remembered(dict):
    """A table of bounded size: when it is full, the entries asked for since it was last full stay, the others go."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.older = most, {}

    def keep(self, key: str, value: bytes) -> None:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value


class PieceEncoder(Remembered):
    """A dictionary from pieces, and the words they consist of, to packed ids that fills itself."""

    def __init__(self, path: str, keeps_space: bool, most: int = CACHE_ENTRIES) -> None:
        super().__init__(most)
        single_threaded()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.lowers = not keeps_space
        self.split: Callable[[str], list[str]] = spaced_pieces if keeps_space else bare_pieces
        self.find = (_WORDS_WITH_SPACE if keeps_space else _BARE_WORDS).findall
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype(f"<u{array(self.code).itemsize}")
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]

    def encode(self, text: str) -> np.ndarray:
        """All ids of one text, without special ones added."""
        return np.frombuffer(b"".join(map(self.__getitem__, self.split(text))), self.dtype)

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            if _LETTERS.fullmatch(piece):
                word = piece.lower() if self.lowers else piece
                ids = self.of_word(word) if word == piece else self[word]
            elif not piece:
                ids = b""
            elif _PLAIN.fullmatch(piece) and not ("<" in piece and any(token in piece for token in self.special)):
                words = self.find(piece.lower() if self.lowers else piece)
                # A word that is cut as a piece is the same word.
                ids = self.of_word(piece) if words == [piece] else b"".join([self[word] for word in words])
            else:
                ids = array(self.code, self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        if len(piece) <= CACHED_LENGTH:
            self.keep(piece, ids)
        return ids

    def of_word(self, word: str) -> bytes:
        written = charmap_decode(word.encode(), "strict", _BYTE_CHARACTERS)[0]
        return array(self.code, map(_id_of, self.tokenize(written))).tobytes()


def encoder(path: str, keeps_space: bool) -> PieceEncoder:
    """The worker's encoder for a tokenizer file."""
    if (path, keeps_space) not in _encoders:
        _encoders[path, keeps_space] = PieceEncoder(path, keeps_space)
    return _encoders[path, keeps_space]
