"""Byte-level BPE of whole texts: the ids of a ``tokenizers`` JSON file, with a word cache."""

from __future__ import annotations

import json
import re

import numpy as np

#: Fixed value: the pre-tokenizer pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_CLEAN = re.compile(r"(?<=\S) (?=\S)")
_RUN = re.compile(r"\s\s")
_PROBE = ["Hello, world's  end\n\n it's 12 345 — naïve Ärzte", " a\tb ", "x" * 300, "don't <|endoftext|> stop"]


def _byte_names() -> dict[str, int]:
    """The printable stand-in of each byte: itself, or the next free code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """``encode(text)`` gives the text's ids as little-endian unsigned 32-bit bytes.

    The merges run in tiktoken's BPE over the JSON file's own vocabulary, because
    it is several times as fast as ``tokenizers``; the constructor compares the two
    on probe texts and refuses a file for which they differ. Strings of special
    tokens are ordinary text. A text is cut at single spaces between non-space
    characters, where no pre-token of the pattern can cross, so that the ids of a
    word are looked up in a cache of at most ``cache_words`` entries.
    """

    def __init__(self, path: str, cache_words: int = 400_000):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = _byte_names()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(names[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self._bpe = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = True
        for text in _PROBE:
            if whole.encode(text, add_special_tokens=False).ids != self._bpe.encode_ordinary(text):
                raise ValueError(f"{path}: not a byte-level BPE whose ids follow its merges")
        self._cache: dict[str, bytes] = {}
        self._room = cache_words

    def _fresh(self, text: str) -> bytes:
        return np.asarray(self._bpe.encode_ordinary(text), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        edges = text[0].isspace() or text[-1].isspace()
        words = _CLEAN.split(text) if edges or _RUN.search(text) else text.split(" ")
        cache = self._cache
        found = list(map(cache.get, words))
        found[0] = self._fresh(words[0])
        if None in found:
            if len(cache) > self._room:
                cache.clear()
            for i, ids in enumerate(found):
                if ids is None:
                    word = words[i]
                    ids = cache.get(word)
                    if ids is None:
                        ids = self._fresh(" " + word)
                        if len(word) <= 64:
                            cache[word] = ids
                    found[i] = ids
        return b"".join(found)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file in a worker process; tasks of the worker share its cache."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
