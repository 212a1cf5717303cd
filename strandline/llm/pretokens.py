"""Exact byte-level BPE through pre-token caches.

A byte-level BPE vocabulary encodes each pre-token on its own, so a text's ids
are those of its pre-tokens, one after another, and a pre-token seen before
needs only a lookup.  Texts are cut here with the public pre-token pattern; the
library's BPE model encodes what no cache knows.  How a character beyond the
plain ones is classed (letter, digit, space, other) is asked of the library's
own pre-tokenizer once, so results never depend on another library's tables.
Only texts with a special token's string go whole through the library.
"""

from __future__ import annotations

import gc
import os
import re
import sys
from array import array
from codecs import charmap_decode
from collections import Counter
from collections.abc import Callable, Iterable
from contextlib import contextmanager

from strandline.llm._common import held

#: Characters whose class (letter, digit, space, other) is the same everywhere.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_ODD = re.compile(r"[^\n\r\t -~À-ɏ]")
#: The public byte-level pre-token pattern, for plain characters.
_PRE_TOKEN = re.compile(rf" ?[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
#: Entries of the young half of a worker's cache; the old half is as large.
CACHE_ENTRIES = 500_000
#: An encoder without a table of frequent pre-tokens makes its own from the first
#: texts it sees; a table this small stays in the processor's cache.
HOT_ENTRIES = 8_192
HOT_TEXTS = 400


def _byte_letters() -> str:
    """The public byte alphabet: visible bytes stand for themselves, the rest follow from 256."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return "".join(chr(b) if b in visible else chr(next(hidden)) for b in range(256))


_ALPHABET = _byte_letters()


def id_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


@contextmanager
def without_collector():
    """Encoding makes millions of objects and no cycles; looking for cycles costs a third of its time."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


class WorkerCache(dict):
    """Pre-token -> value, bounded: a full young half becomes the old half."""

    def __init__(self, encode: Callable[[str], object], bound: int = CACHE_ENTRIES):
        super().__init__()
        self.encode, self.bound, self.old = encode, bound, {}

    def __missing__(self, token: str):
        value = self.old.get(token)
        if value is None:
            value = self.encode(token)
        if len(self) >= self.bound:
            self.old = {}  # the old half goes before the young one is copied
            self.old = dict(self)
            self.clear()
        self[token] = value
        return value


def frequent_first(table: Iterable[tuple[str, object]], rest: WorkerCache) -> dict:
    """A fixed table of frequent pre-tokens; the rest is looked up in the worker's cache.

    A quarter of all lookups goes on to the cache, so no Python function stands between the two.
    """
    return type("FrequentFirst", (dict,), {"__missing__": staticmethod(rest.__getitem__)})(table)


class _Classes(dict):
    """Code point -> a plain character of the same class; the library's pre-tokenizer is asked once for each."""

    def __init__(self, cut: Callable[[str], list]):
        super().__init__({i: i for i in (*range(32, 127), 9, 10, 13)})
        self.cut = cut

    def __missing__(self, code: int) -> str:
        char = chr(code)
        self[code] = next((mark for mark in "a0!" if len(self.cut(mark + char)) == 1), "\t")
        return self[code]


class Encoder:
    """``value`` makes something of a list of ids; a text's value is its list of parts."""

    def __init__(self, path: str, value: Callable, frequent: Iterable[tuple[str, object]] | None = None, entries: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.value = value
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._whole = re.compile("|".join(map(re.escape, added)) or r"(?!)").search
        self._classes = _Classes(self.tokenizer.pre_tokenizer.pre_tokenize_str)
        self._model = self.tokenizer.model.tokenize
        self.cache = WorkerCache(self._pre_token, entries)
        self.known = frequent_first(frequent, self.cache) if frequent is not None else self.cache
        self._seen: Counter | None = Counter() if frequent is None else None
        self._texts = 0

    @classmethod
    def shared(cls, path: str, entries: int = CACHE_ENTRIES) -> Encoder:
        """This worker's encoder to id bytes: tasks that follow find its caches filled."""
        return held(cls, sys.intern(f"{entries} {path}"), lambda: cls(path, id_bytes, entries=entries))

    def pre_tokens(self, text: str) -> list[str]:
        if _ODD.search(text) is None:
            return _PRE_TOKEN.findall(text)
        return [text[m.start() : m.end()] for m in _PRE_TOKEN.finditer(text.translate(self._classes))]

    def _learn(self, tokens: list[str]) -> None:
        self._seen.update(tokens)
        self._texts += 1
        if self._texts == HOT_TEXTS:
            self.known = frequent_first([(t, self.cache[t]) for t, _ in self._seen.most_common(HOT_ENTRIES)], self.cache)
            self._seen = None

    def _pre_token(self, token: str):
        letters, _ = charmap_decode(token.encode(), "strict", _ALPHABET)
        return self.value([t.id for t in self._model(letters)])

    def parts(self, text: str | None) -> list:
        """Values whose sum is that of the whole text as the library encodes it."""
        if not text:
            return []
        if self._whole(text):
            return [self.value(self.tokenizer.encode(text, add_special_tokens=False).ids)]
        tokens = self.pre_tokens(text)
        if self._seen is not None:
            self._learn(tokens)
        return list(map(self.known.__getitem__, tokens))
