"""Byte-level BPE encoding of whole texts.

Ids are those of the ``tokenizers`` library for the given ``.json`` file. A
text whose characters all lie in long-settled Unicode ranges, where every
version agrees on letters, digits and spaces, is encoded by ``tiktoken`` with
the same vocabulary and merge order, which yields the same ids in a quarter of
the time. A text with other characters or with a special token, one whose blanks
run on for longer than tiktoken's splitter can follow, and every text
for files of another shape (no byte-level BPE without normaliser, ids that do
not follow the merge order), goes through ``tokenizers`` itself.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import cached_property

import numpy as np

# Fixed value: the published splitting pattern of byte-level BPE (GPT-2).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Latin, Greek, Cyrillic, general punctuation, kana, Han and Hangul as assigned
# since Unicode 5.
_UNSETTLED = re.compile(
    "[^\u0000-\u024f\u0391-\u03a1\u03a3-\u03ff\u0400-\u0523\u2010-\u2027\u2030-\u205e"
    "\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]"
)


def tokenizer_digest(path: str) -> str:
    """Version of a tokenizer: SHA-256 of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _byte_of_char() -> dict[str, int]:
    """The published one-to-one map between bytes and printable characters."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def _fast_encoding(spec: dict):
    """A tiktoken encoding with the file's vocabulary; None if it would differ."""
    import tiktoken

    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (
        model.get("type", "BPE") == "BPE"
        and not spec.get("normalizer")
        and not model.get("continuing_subword_prefix")
        and not model.get("end_of_word_suffix")
        and not model.get("dropout")
        and not model.get("ignore_merges")
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and pre.get("use_regex", True)
    )
    if not plain:
        return None
    special = {t["content"] for t in spec.get("added_tokens", [])}
    merged = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in model["merges"]]
    ids = [model["vocab"][m] for m in merged]
    if ids != sorted(ids):
        return None
    to_byte = _byte_of_char()
    ranks = {
        bytes(to_byte[c] for c in word): i for word, i in model["vocab"].items() if word not in special
    }
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Encodes texts with one tokenizer file; one instance a Python worker."""

    _made: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str) -> None:
        self._path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._special = [t["content"] for t in spec.get("added_tokens", [])]
        self._fast = _fast_encoding(spec)

    @cached_property
    def _library(self):
        """The reference itself, loaded by the first text that needs it."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(self._path)
        library.no_truncation()
        library.no_padding()
        return library

    def ids(self, text: str) -> np.ndarray:
        """The token ids of a text, as little-endian unsigned 32-bit numbers."""
        if not text:
            return np.empty(0, "<u4")
        if (
            self._fast is not None
            and not any(s in text for s in self._special)
            and (text.isascii() or not _UNSETTLED.search(text))
        ):
            try:
                return self._fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # its splitter gives up on very long runs of blanks
                pass
        return np.array(self._library.encode(text, add_special_tokens=False).ids, "<u4")
