"""Token ids of whole texts by a public tokenizer file, cached by stretches without spaces.

A tokenizer that drops white space gives the same ids for a text and for its stretches between
spaces one after the other. So each distinct stretch is looked up once per Python process, as
long as the cache holds it, and the ids of a text are put together from the cache.

Stretches of Latin letters, digits and ASCII signs are split and lower-cased here, and only
their runs go to the vocabulary; all others go through the library whole. Both give the ids
that the library gives for the whole text, which the tests compare.
"""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache

#: Entries that a process keeps; further ones are looked up anew, which bounds its memory.
CACHE_ENTRIES = 400_000
#: Stretches kept for a while when those are full, so that a text's own words are looked up once.
RECENT_ENTRIES = 20_000
#: Longer stretches are not worth a place in the cache.
CACHE_CHARS = 48

#: The pre-token pattern of the word vocabulary, for Latin letters and ASCII signs.
_RUNS = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+"
).findall
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*").fullmatch


@lru_cache(maxsize=4)
def library(path: str):
    """The tokenizer of one file, loaded once per Python process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies.

    Fixed rule: printable bytes stand for themselves, the others for the letters from 256 on.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def packed(ids: list[int]) -> bytes:
    """Little-endian 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class StretchIds(dict):
    """Ids of texts, for word vocabularies of byte letters that drop all white space.

    It is its own cache of stretches; one that is not in it is looked up as it is met.
    """

    def __init__(self, path: str):
        super().__init__({"": b""})
        self.tokenizer = library(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.recent: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def run(self, run: str) -> bytes:
        text = run if run.isascii() else "".join(map(self.letters.__getitem__, run.encode()))
        ids = packed([t.id for t in self.model.tokenize(text)])
        if len(self.runs) < CACHE_ENTRIES:
            self.runs[run] = ids
        return ids

    def learn(self, stretch: str) -> bytes:
        if stretch.isascii() and stretch.isalpha():
            run = stretch.lower()
            return self.runs.get(run) or self.run(run)
        if _PLAIN(stretch) and not ("<|" in stretch and any(x in stretch for x in self.special)):
            runs = self.runs
            return b"".join([runs.get(p) or self.run(p) for p in _RUNS(stretch.lower())])
        encoded = self.tokenizer.encode_batch_fast([stretch], add_special_tokens=False)
        return packed(encoded[0].ids)

    def __missing__(self, stretch: str) -> bytes:
        recent = self.recent
        ids = recent.get(stretch)
        if ids is None:
            ids = self.learn(stretch)
            if len(self) < CACHE_ENTRIES and len(stretch) <= CACHE_CHARS:
                self[stretch] = ids
            else:
                if len(recent) >= RECENT_ENTRIES or len(stretch) > CACHE_CHARS:
                    recent.clear()
                recent[stretch] = ids
        return ids

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        get = self.__getitem__
        return [
            b"".join(map(get, t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))
            for t in texts
        ]


@lru_cache(maxsize=2)
def stretch_ids(path: str) -> StretchIds:
    """One per Python process, so that the tasks of a worker share their cache."""
    return StretchIds(path)
