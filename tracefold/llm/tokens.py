"""Token counts under a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os

import numpy as np

#: Folder of the vocabulary files; a parameter of every operator that counts tokens.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: how that vocabulary cuts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict[str, tuple] = {}


def encoder(folder: str = TOKENIZERS, name: str = VOCABULARY):
    """The encoding and, by token, the number of bytes; loaded once per worker."""
    path = os.path.join(folder, name)
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for b, r in ranks.items():
            lengths[r] = len(b)
        _loaded[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths
    return _loaded[path]
