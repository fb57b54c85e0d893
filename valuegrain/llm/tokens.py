"""Token ids of whole texts by a public tokenizer file, with a cache of word pieces.

The tokenizer lower-cases, drops white space and splits a text by a fixed pattern into pieces
that are encoded on their own and never hold white space, so equal words have equal ids.  Texts of
common Latin characters are split here and only pieces not seen before go to the tokenizer; all
other texts (and those that hold its special tokens) go to it whole.  Both ways give the same ids.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

from .common import kept

#: Characters for which Python's and the tokenizer's lower-casing and classes agree.
_OTHER = re.compile("[^\t\n\x0b\x0c\r -~\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ſ–—‘-‟•…€]|<\\|(?:start|end)oftext\\|>")
#: The tokenizer's own pattern, for those characters.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+").findall
#: Words and pieces remembered by a worker (about 200 bytes each): the first it meets, so the common ones;
#: after STALE times as many others, it starts anew.
STALE = 20
MAX_CACHE = 150_000
#: Byte-level tokenizers write visible Latin-1 bytes as themselves, the others as characters from 256 on.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Words(dict):
    """Ids of words; a word not known is noted and stands for itself until it is."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> str:
        self.new.append(word)
        return word


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.late = 0  # words met since the caches were full
        self.words = _Words()  # of texts split at white space
        self.pieces: dict[str, bytes] = {}  # of words split by the pattern

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:  # one at a time: an encoding holds some 100 bytes a token
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            yield struct.pack(f"<{len(ids)}I", *ids)

    def _encode_pieces(self, pieces: list[str]) -> Iterator[bytes]:
        """The same for single pieces: they need no more than the model, on their bytes' characters."""
        for p in pieces:
            found = self.model.tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(_BYTES))
            yield struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        split = list(map(_PIECES, words))
        new = list(set().union(*split).difference(self.pieces))
        known = dict(zip(new, self._encode_pieces(new), strict=True))
        if len(self.pieces) < MAX_CACHE:
            self.pieces.update(known)
        get, other = self.pieces.get, known.get
        return {w: b"".join([get(x) or other(x) for x in p]) for w, p in zip(words, split, strict=True)}

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        split = [None if t and _OTHER.search(t) else t.lower().split() if t else [] for t in texts]
        whole_ids = self._encode([t for t, words in zip(texts, split, strict=True) if words is None])
        get, new, out, open_rows = self.words.__getitem__, self.words.new, [], []
        for i, words in enumerate(split):
            if words is None:
                out.append(next(whole_ids))
                continue
            before = len(new)
            found = list(map(get, words))
            if len(new) > before:
                open_rows.append(i)
                out.append(found)
            else:
                out.append(b"".join(found))
        if new:
            known = self._learn(list(set(new)))
            if len(self.words) < MAX_CACHE:
                self.words.update(known)
            else:
                self.late += len(known)
            if self.late > STALE * MAX_CACHE:  # other words are common by now
                self.words.clear()
                self.pieces.clear()
                self.late = 0
            new.clear()
            for i in open_rows:
                out[i] = b"".join([x if type(x) is bytes else known[x] for x in out[i]])
        return out


def encoder(path: str) -> Encoder:
    """One per worker process, so that later tasks find its caches filled."""
    return kept(path, lambda: Encoder(path))
