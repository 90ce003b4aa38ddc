"""Pre-tokens of the library's two BPE tokenizers, and their ids, with caches that live as long as a Python worker."""

from __future__ import annotations

import unicodedata

import regex
from tokenizers import Tokenizer

# The split patterns in the tokenizers' files.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""


def byte_letters() -> dict[int, int]:
    """The character that stands for each byte in the vocabularies: printable ones for themselves, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + k for k, b in enumerate(rest)}


class PreTokenizer:
    """Splits whole texts as the library does and encodes one pre-token at a time.

    Special strings inside a text are single ids, as is the library's default. Texts with unassigned characters are left
    to the library (`plain` is false for them).
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.words = self.library.normalizer is not None
        self.find = regex.compile(WORD_PATTERN if self.words else BYTE_PATTERN).findall
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.assigned: set[str] = set()
        self.letters = byte_letters()
        self.numbers = {chr(c): b for b, c in self.letters.items()}

    def plain(self, text: str) -> bool:
        """False if a character has no category here: its class may differ between Unicode versions."""
        if text.isascii():
            return True
        new = set(text) - self.assigned
        self.assigned |= {c for c in new if unicodedata.category(c) != "Cn"}
        return new <= self.assigned

    def parts(self, text: str) -> list[str]:
        """Stretches of the text; every second one is a special string."""
        return self.split_special(text) if "<|" in text else [text]

    def pieces(self, part: str) -> list[str]:
        if self.words:
            # The library lower-cases character by character, so a final sigma has no form of its own.
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
        return self.find(part)

    def ids(self, piece: str) -> list[int]:
        """Ids of one pre-token, by the library's model alone."""
        return [t.id for t in self.library.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]

    def surface(self, piece: str) -> str | None:
        """The text that a piece of the vocabulary stands for; none if it is a part of a character."""
        try:
            return bytes(self.numbers[c] for c in piece).decode()
        except (KeyError, UnicodeDecodeError):
            return None

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids


_WORKER: dict[str, PreTokenizer] = {}


def pretokenizer(path: str) -> PreTokenizer:
    """One per Python worker and vocabulary."""
    if path not in _WORKER:
        _WORKER[path] = PreTokenizer(path)
    return _WORKER[path]


class Bounded(dict):
    """A dict that makes missing values and starts again from its first entries when it is full."""

    def __init__(self, make, first=(), most: int = 300_000):
        super().__init__(first)
        self.make, self.first, self.most = make, dict(first), most

    def __missing__(self, key):
        if len(self) >= self.most + len(self.first):
            self.clear()
            self.update(self.first)
        if len(key) <= 64:
            self[key] = value = self.make(key)
            return value
        return self.make(key)


class Recent(dict):
    """A dict that makes missing values. It holds about `most` of them in two generations: when the young one is full, it becomes the old one, whose values stay if they are asked for again."""

    def __init__(self, make, most: int = 300_000):
        super().__init__()
        self.make, self.most, self.old = make, most // 2, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > 64:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
