"""Lines of texts: normalised digests with offsets. Shared by line dedup and by the line rules."""

from __future__ import annotations

import hashlib
import re

_SPACES = re.compile(r"[\x20\x09-\x0D]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]")


def normalised(line: str) -> str:
    """Lower case, single spaces, no space at the ends."""
    return _SPACES.sub(" ", line).strip(" ").lower()


def digest(line: str) -> bytes:
    """128 bits of the normalised line."""
    return hashlib.blake2b(normalised(line).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def count_words(line: str) -> int:
    return len([w for w in _SPACES.split(line) if w])


def has_words(line: str) -> bool:
    return _WORD.search(line) is not None


def words_of(line: str) -> list[str]:
    return [w for w in _SPACES.split(line) if w]


def digest_of(words: list[str]) -> bytes:
    """``digest`` of the line that has these words."""
    return hashlib.blake2b(" ".join(words).lower().encode("utf-8", "surrogatepass"), digest_size=16).digest()
