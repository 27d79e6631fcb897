"""Exact token ids and counts by caching the pieces of texts between spaces.

Byte-level and word-level BPE never join characters across a space that a
non-space follows, so a text may be cut in front of every such space and the
pieces encoded one by one.  Natural text repeats its pieces: a worker keeps the
results of those it has seen and asks the tokenizer for the rest.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

#: Cached pieces of a worker, the first that it meets.  Longer pieces are never kept.
CACHE_ENTRIES = 1_000_000
CACHE_PIECE = 64

_LOADED: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a .json file, loaded once in a worker and kept to its task's thread."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


class PieceCache(dict):
    """piece -> result; a missing piece is made and kept while there is room."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece):
        found = self.make(piece)
        if len(piece) <= CACHE_PIECE and len(self) < CACHE_ENTRIES:
            self[piece] = found
        return found


def worker_cache(name: str, make) -> PieceCache:
    """A cache that the tasks of a Python worker share."""
    if name not in _LOADED:
        _LOADED[name] = PieceCache(make)
    return _LOADED[name]


# a space or line end is the first character of a new piece only where something other than white space follows
_LOOSE_SPACE = re.compile(r"[ \n](?=\s|\Z)")
_PIECES = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
_OTHER_SPACE = re.compile(r"[^\S \t-\r]")


def pieces(text: str) -> Iterable[str]:
    """Cut a text into pieces that a byte-level tokenizer with optional leading spaces encodes independently.

    All pieces but the first start with white space; no character is lost.  A
    text where runs of spaces meet other than ASCII white space stays whole.
    """
    if _LOOSE_SPACE.search(text):
        return [text] if _OTHER_SPACE.search(text) else _PIECES.findall(text)
    out = []
    for line in text.split("\n"):
        first, *rest = line.split(" ")
        out.append("\n" + first if out else first)
        out += [" " + x for x in rest]
    return out


def slices(texts: list[str], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of a list of texts that hold about ``chars`` characters, one text at least."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
