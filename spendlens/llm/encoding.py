"""Whole-text encoding with a public tokenizer, through a bounded cache of space-delimited pieces.

The library encodes about a megabyte a second, most of it words it has met before. A byte-level tokenizer that cuts its
input with the usual word pattern never joins characters across a space that is followed by something other than white
space: every alternative of the pattern takes a space only as its first character or as part of a run of white space. So a
text can be cut there, every piece can be encoded by the library alone, and the pieces' ids joined are the ids of the text.
A line end between two characters that aren't white space is a token boundary on both sides, too.

Texts that hold a special token's string or a marker character, and tokenizers of another build, are encoded whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

_CUT = re.compile(r" (?=\S)")
_LINE = "\0"  # marks a piece that begins a line or the text: no space stands before it
_JOINED = 256


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes, or token counts: what the library gives for each whole text.

    `known` maps pieces that follow a space to their counts (when counting): the cache always holds these. Besides, it holds
    `limit` pieces and those of one call at most; a full one is emptied, as what it holds can be made again.
    """

    def __init__(self, path: str, counting: bool = False, limit: int = 1_200_000, known: dict[str, int] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        cutter = parts.get("pre_tokenizer") or {}
        self.cuts = (
            cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True)
            and parts.get("normalizer") is None and parts["model"]["type"] == "BPE"
        )
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.vocabulary_size = max(vocabulary.values()) + 1
        self.widths = np.zeros(self.vocabulary_size, np.int64)  # bytes of text behind an id; one character stands for one
        for token, i in vocabulary.items():
            self.widths[i] = len(token)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.counting, self.limit, self.known = counting, limit, known or {}
        self.cache: dict[str, bytes | int] = dict(self.known)

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _packed(self, ids: list[int]) -> bytes | int:
        return len(ids) if self.counting else np.array(ids, "<u4").tobytes()

    def _pieces(self, text: str) -> list[str] | None:
        """Pieces of the text without the space before each; None if the text must not be cut."""
        if not self.cuts or _LINE in text or any(s in text for s in self.special):
            return None
        words, lines = text.split(), text.count("\n")
        between = len(words) - 1
        if text.count(" ") + lines != between or sum(map(len, words)) + between != len(text):
            return _CUT.split(_LINE + text)  # other white space, or runs of it
        return (_LINE + text.replace("\n", f" {_LINE}\n {_LINE}") if lines else _LINE + text).split(" ")

    def _fill(self, missing: list[str]) -> None:
        """Encodes pieces, many words joined to one text for each call."""
        rest = []
        for start in range(0, len(missing), _JOINED * 64):
            some = missing[start : start + _JOINED * 64]
            # a word that begins a line gets a line end before it, whose token is left out below
            words = ["\n" + p[1:] if p[:1] == _LINE else " " + p for p in some]
            if len("".join(words).split()) != len(some):  # some are empty or hold white space
                plain = [len(w.split()) == 1 and w[1:].strip() == w[1:] != "" for w in words]
                rest += [p for p, ok in zip(some, plain) if not ok]
                some, words = ([x for x, ok in zip(xs, plain) if ok] for xs in (some, words))
            joined = ["".join(words[i : i + _JOINED]) for i in range(0, len(words), _JOINED)]
            text = np.frombuffer("".join(joined).encode(), np.uint8)
            first = np.flatnonzero((text == 0x20) | (text == 0x0A))  # where words begin: they hold no others
            ids = np.array([i for e in self._encoded(joined) for i in e], "<u4")
            reached = np.cumsum(self.widths[ids])
            ends = np.append(first[1:], len(text))
            to = np.searchsorted(reached, ends)
            if len(first) != len(some) or not len(ids) or reached[-1] != len(text) or not np.array_equal(reached[to], ends):
                rest += some  # never with a byte-level vocabulary that has all bytes
                continue
            to += 1
            at = np.append(0, to[:-1]) + (text[first] == 0x0A)
            if self.counting:
                self.cache.update(zip(some, (to - at).tolist()))
            else:
                data = ids.tobytes()
                self.cache.update(zip(some, [data[i:j] for i, j in zip((4 * at).tolist(), (4 * to).tolist())]))
        if rest:
            texts = [p[1:] if p[:1] == _LINE else " " + p for p in rest]
            self.cache.update(zip(rest, map(self._packed, self._encoded(texts))))

    def encode(self, texts: list[str]) -> list[bytes] | list[int]:
        """One result for each text, in order. Call it with some hundred kilobytes of text at a time."""
        if len(self.cache) > self.limit:
            self.cache = dict(self.known)
        cut = [self._pieces(t) for t in texts]
        missing = list(set().union(*(c for c in cut if c)).difference(self.cache))
        self._fill(missing)
        total = sum if self.counting else b"".join
        found = [self._whole(t) if c is None else total(map(self.cache.__getitem__, c)) for t, c in zip(texts, cut)]
        for piece in missing:
            if len(piece) > 256:  # hardly met again
                del self.cache[piece]
        return found

    def _whole(self, text: str) -> bytes | int:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, counting: bool = False) -> Encoder:
    """The worker's encoder; its cache lives as long as the worker, over all tasks."""
    key = (path, counting)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, counting)
    return _ENCODERS[key]


def in_portions(texts: list[str], characters: int = 500_000):
    """Slices of the texts that hold about so many characters each; a longer text is one of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= characters:
            yield texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def public_path(name: str) -> str:
    """Place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
