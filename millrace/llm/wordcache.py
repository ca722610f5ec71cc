"""Token ids of whole texts through a bounded cache of white-space separated pieces.

A tokenizer that pre-splits at white space gives a text the ids of its pieces,
one after another, whenever each cut lies at a safe boundary: before white
space that follows a character that is none. Most pieces of a corpus repeat, so
the library only sees each new piece once per worker and cache generation.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from unicodedata import is_normalized

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces kept by one worker before its cache starts afresh, and the characters of a piece that is kept at most.
CACHE_PIECES = 400_000
CACHED_CHARS = 64
#: Bytes of text handed to the library in one call.
BATCH_BYTES = 1 << 18
#: A text that is no sequence of pieces is cut at safe boundaries beyond this many characters.
LONG_CHARS = 1 << 16

_PIECE = re.compile(r"\s*\S+|\s+")
#: White space for Python's `re`, ordinary characters for the tokenizers' patterns.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_SAFE = re.compile(r"(?<=[!-~])(?=[ \n])")

_loaded: dict[str, object] = {}


def load(path: str):
    """The tokenizer of a file; a worker loads it once."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def _shape(tokenizer) -> tuple[str, str]:
    """The file's normalizer and pre-tokenizer."""
    whole = json.loads(tokenizer.to_str())
    return json.dumps(whole["normalizer"], sort_keys=True), json.dumps(whole["pre_tokenizer"], sort_keys=True)


def keeps_blanks(tokenizer) -> bool:
    """True if texts are split by the byte-level pattern alone, so that white space begins a piece."""
    normalizer, pre = (json.loads(x) for x in _shape(tokenizer))
    return normalizer is None and bool(pre) and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]


def drops_blanks(tokenizer) -> bool:
    """True if texts are put in NFC and lower case and split into runs that no white space is in."""
    normalizer, pre = (json.loads(x) for x in _shape(tokenizer))
    steps = [x["type"] for x in (normalizer or {}).get("normalizers", [])]
    splits = (pre or {}).get("pretokenizers", [])
    if steps != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in splits] != ["Split", "ByteLevel"]:
        return False
    return splits[0]["behavior"] == "Removed" and splits[0]["invert"] and splits[0]["pattern"]["Regex"].endswith("|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+")


def plain(text: str) -> bool:
    """True if cuts at Python's white space are safe and no special string can occur."""
    return "<|" not in text and not any(c in text for c in _SEPARATORS)


def cut_long(text: str, limit: int = LONG_CHARS) -> list[str]:
    """Cuts a text into parts of about `limit` characters at safe boundaries only.

    A boundary lies between a printable ASCII character and a blank or newline,
    where no tokenizer pattern reaches across. Text without one stays whole.
    """
    if len(text) <= limit:
        return [text]
    parts, at = [], 0
    while len(text) - at > limit:
        found = _SAFE.search(text, at + limit)
        if found is None:
            break
        parts.append(text[at : found.start()])
        at = found.start()
    parts.append(text[at:])
    return parts


def byte_batches(texts: Iterable[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Groups texts so that each group holds about `limit` bytes, whatever their number."""
    batch, held = [], 0
    for text in texts:
        n = len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))
        if batch and held + n > limit:
            yield batch
            batch, held = [], 0
        batch.append(text)
        held += n
    if batch:
        yield batch


class LengthCache:
    """Numbers of tokens of texts: by pieces, for tokenizers that keep white space in them, or else of whole texts."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.by_pieces = keeps_blanks(self.tokenizer)
        self.known: dict[str, int] = {}

    def _encode(self, pieces: list[str]) -> Iterator[int]:
        for batch in byte_batches(pieces):
            for found in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False):
                yield len(found)

    def _learn(self, pieces: list[str]) -> None:
        # " word," is " word" and ",": letters never share a token with the mark after them.
        known, stems, joined = self.known, [], []
        for piece in pieces:
            if piece[-1] in ".," and len(piece) > 1 and piece[:-1].lstrip(" ").isalpha() and piece.count(" ") <= 1:
                joined.append(piece)
                stems += (piece[:-1], piece[-1])
            else:
                stems.append(piece)
        new = [x for x in dict.fromkeys(stems) if x not in known]
        known.update(zip(new, self._encode(new)))
        for piece in joined:
            known[piece] = known[piece[:-1]] + known[piece[-1]]

    def lengths(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text, in order."""
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        out, known = [0] * len(texts), self.known
        split, whole = {}, []
        for i, text in enumerate(texts):
            if not self.by_pieces:
                whole.append((i, text))
            elif plain(text):
                split[i] = _PIECE.findall(text)
            else:
                whole += ((i, part) for part in cut_long(text))
        missing = {x for pieces in split.values() for x in pieces if x not in known}
        self._learn(sorted(missing))
        for i, pieces in split.items():
            out[i] = sum(map(known.__getitem__, pieces))
        for x in missing:
            if len(x) > CACHED_CHARS:
                known.pop(x, None)
                known.pop(x[:-1], None)
        for (i, _), n in zip(whole, self._encode([part for _, part in whole])):
            out[i] += n
        return out


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write each byte as one visible character: printable
    Latin-1 characters stand for themselves, the other bytes are 256, 257, ... in turn."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: 256 + i for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()


class IdCache(dict):
    """Piece -> its ids as little-endian unsigned 16-bit bytes, for a lower-casing
    tokenizer that drops white space. Vocabularies beyond 65,536 ids are refused."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = load(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids don't fit into 16 bits")
        self.model, self.by_pieces = self.tokenizer.model, drops_blanks(self.tokenizer)

    def _pack(self, ids: list[int]) -> bytes:
        return b"".join(x.to_bytes(2, "little") for x in ids)

    def __missing__(self, piece: str) -> bytes:
        if piece.isalpha() and piece.isascii():
            # The byte-level form of lower-case ASCII letters is the word itself.
            found = self._pack([t.id for t in self.model.tokenize(piece)])
        elif piece.isalpha() and is_normalized("NFC", piece):
            letters = piece.encode("utf-8").decode("latin-1").translate(_LETTERS)
            found = self._pack([t.id for t in self.model.tokenize(letters)])
        elif piece[-1] in ".," and piece[:-1].isalpha():
            found = self[piece[:-1]] + self[piece[-1]]
        else:
            found = self.whole(piece)
        if len(piece) <= CACHED_CHARS:
            self[piece] = found
        return found

    def whole(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def ids(self, text: str) -> bytes:
        """The ids of a whole text."""
        if len(self) > CACHE_PIECES:
            self.clear()
        if not self.by_pieces:
            return self.whole(text)
        if not plain(text) or "Σ" in text:
            return b"".join(map(self.whole, cut_long(text)))
        return b"".join(map(self.__getitem__, text.lower().split()))
