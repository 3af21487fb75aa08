"""Token counts by a public byte-level vocabulary. Its folder is a parameter; the driver reads it and the tasks get its bytes."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern published with the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary(folder: str, name: str = VOCABULARY) -> bytes:
    with open(os.path.join(folder, name), "rb") as f:
        return f.read()


@lru_cache(maxsize=4)
def encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: list[str], vocabulary: bytes) -> list[int]:
    """Tokens of each text, over the whole text."""
    enc = encoding(vocabulary)
    out = []
    for t in texts:
        try:
            out.append(len(enc.encode_to_numpy(t)) if t else 0)
        except UnicodeEncodeError:  # lone surrogates
            out.append(len(enc.encode_ordinary(t.encode("utf-8", "replace").decode())))
    return out
