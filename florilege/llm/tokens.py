"""Public tokenizers inside tasks: loaded once a Python worker, from a path parameter."""

from __future__ import annotations

import base64

import numpy as np

#: Folder of the vocabulary files; every operator takes another one as a parameter.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict[str, tuple] = {}


def load(folder: str = TOKENIZERS, name: str = VOCABULARY):
    """(encoder, bytes of each token) of a byte-level vocabulary."""
    path = f"{folder}/{name}"
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        width = np.zeros(max(ranks.values()) + 1, "i4")
        for piece, rank in ranks.items():
            width[rank] = len(piece)
        _loaded[path] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), width
    return _loaded[path]


def count(text: str | None, folder: str = TOKENIZERS, name: str = VOCABULARY) -> int:
    return len(encode(text, load(folder, name)[0])) if text else 0


def encode(text: str, encoder, piece: int = 100_000) -> list[int]:
    """Tokens of a text; very long ones are cut at blanks so that one call stays short."""
    if len(text) <= piece:
        return encoder.encode_ordinary(text)
    out, a = [], 0
    while a < len(text):
        b = min(len(text), a + piece)
        if b < len(text):
            cut = text.rfind(" ", a + 1, b)
            b = cut if cut > a else b
        out += encoder.encode_ordinary(text[a:b])
        a = b
    return out
