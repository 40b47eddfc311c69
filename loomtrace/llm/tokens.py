"""Public tokenizers by path. The files stay where they are; every executor must see the folder under the same path."""

from __future__ import annotations

import base64
import functools
import os

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@functools.lru_cache(maxsize=2)
def encoder(folder: str = TOKENIZERS, name: str = VOCABULARY):
    """The byte-level tokenizer of a ranks file; loaded once a process."""
    import tiktoken

    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    # fixed value: the published word pattern of this family of vocabularies
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def size(folder: str = TOKENIZERS, name: str = VOCABULARY) -> int:
    """One more than the largest id."""
    return encoder(folder, name).max_token_value + 1
