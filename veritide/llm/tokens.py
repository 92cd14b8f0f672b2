"""Exact token ids by the public tokenizer files, with a bounded memo of short chunks.

A byte-level BPE that pre-tokenises by the usual pattern always begins a new pre-token at a single
space or line feed between two non-space characters.  Texts are cut there, so that the library
encodes each distinct chunk once per worker; texts with runs of white space are cut by a regular
expression at the same kind of place.  Every other tokenizer encodes whole texts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
from array import array

import numpy as np

_NATIVE = sys.byteorder == "little" and array("I").itemsize == 4

_RUN = re.compile(r"\s\s")
_STOPS = (".", ",")
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


def file_digest(path: str) -> str:
    """Hex SHA-256 of the tokenizer file: the version under which counts are cached."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def chunkable(path: str) -> bool:
    """Whether texts may be cut into chunks before this tokenizer encodes them."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    added = spec.get("added_tokens") or []
    return (
        spec.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added)
    )


def _byte_chars() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if visible, else the next from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_CHARS = _byte_chars()


def word_model(path: str):
    """The tokenizer's BPE model by itself, without its cache (words come from the memo); None if it has options."""
    from tokenizers import models

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)["model"]
    plain = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    if spec.get("type", "BPE") != "BPE" or any(spec.get(k) for k in plain):
        return None
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["merges"]]
    return models.BPE(spec["vocab"], merges, cache_capacity=0)


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids (``ids``) or counts them (``counts``)."""

    def __init__(self, path: str, memo: int = 500_000):
        self.path, self.memo = path, memo
        self.by_chunk = chunkable(path)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._raw = lambda texts: model.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_padding()
            model.no_truncation()
            self._raw = lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]
        self.model = word_model(path) if self.by_chunk else None
        self._inner: dict = {}
        self._whole: dict = {}

    def _chunks(self, text: str) -> tuple[list[str], list[str]]:
        """Chunks encoded as they are, then chunks encoded behind one space (or as a line's begin)."""
        if _RUN.search(text):
            return _CUT.split(text), []
        parts = text.replace("\n", " \n").split(" ")
        return parts[:1], parts[1:]

    def _encode(self, memo: dict, new: list[str], prefix: str, value) -> None:
        if self.model:  # a word of letters is one pre-token: the library's model takes it as it is
            words = [c for c in new if c.isalpha() and max(c) < "\u0250"]
            if words:
                run = self.model.tokenize
                head = _BYTE_CHARS[32] if prefix else ""
                memo.update((c, value([t.id for t in run(head + c.encode().decode("latin-1").translate(_BYTE_CHARS))])) for c in words)
                new = set(new).difference(words)
        new = list(new)
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            got = self._raw([c if c[:1] == "\n" else prefix + c for c in some])
            memo.update(zip(some, map(value, got), strict=True))

    def _known(self, cut: list[tuple[list[str], list[str]]], value) -> None:
        for memo, k, prefix in ((self._whole, 0, ""), (self._inner, 1, " ")):
            new = set().union(*(parts[k] for parts in cut)).difference(memo)
            # A stop or comma behind a letter is a pre-token of its own: the word before it is looked up alone.
            ends = [c for c in new if c[-1:] in _STOPS and c[-2:-1].isalpha() and c[-2] < "\u0250"]
            new.difference_update(ends)
            new.update(b for c in ends if (b := c[:-1]) not in memo)
            self._encode(memo, list(new), prefix, value)
            if ends:
                stop = dict(zip(_STOPS, map(value, self._raw(list(_STOPS))), strict=True))
                memo.update((c, memo[c[:-1]] + stop[c[-1]]) for c in ends)

    def _bounded(self) -> None:
        """Drop the younger half of a full memo: frequent chunks come early, so the older half is worth more."""
        for memo in (self._whole, self._inner):
            if len(memo) > self.memo:
                for c in list(memo)[self.memo // 2 :]:
                    del memo[c]

    def _each(self, texts: list[str], value, empty, join):
        for at in range(0, len(texts), 128):
            some = texts[at : at + 128]
            if not self.by_chunk:
                yield from (value(ids) if len(ids) else empty for ids in self._raw(some))
                continue
            cut = [self._chunks(t) for t in some]
            self._known(cut, value)
            whole, inner = self._whole.__getitem__, self._inner.__getitem__
            for a, b in cut:
                yield join(map(whole, a), map(inner, b))
            self._bounded()

    def counts(self, texts: list[str]):
        return self._each(texts, len, 0, lambda a, b: sum(a) + sum(b))

    def ids(self, texts: list[str]):
        def packed(ids):
            return array("I", ids).tobytes() if _NATIVE else np.asarray(ids, "<u4").tobytes()

        return self._each(texts, packed, b"", lambda a, b: b"".join(a) + b"".join(b))


_ENCODERS: dict = {}


def encoder(path: str, use: str) -> Encoder:
    """One encoder for each file and use in a worker process; its memo lives across tasks."""
    if (path, use) not in _ENCODERS:
        _ENCODERS[path, use] = Encoder(path)
    return _ENCODERS[path, use]


def forget() -> None:
    """Drop the worker's encoders and their memos."""
    _ENCODERS.clear()
