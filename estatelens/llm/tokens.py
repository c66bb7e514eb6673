"""Byte-level BPE ids of whole texts."""

from __future__ import annotations

import base64

import numpy as np

from .common import ship

ship(__name__)


class Encoder:
    """Ids of texts by a vocabulary's ranks; special tokens inside a text are plain text."""

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str, end: int) -> np.ndarray:
        """The text's ids with `end` behind them."""
        return np.append(self.bpe.encode_to_numpy(text, disallowed_special=()), np.uint32(end))
