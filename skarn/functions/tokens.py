"""Token counts by a byte-pair vocabulary, for texts of files."""

from __future__ import annotations

import base64
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the pre-token pattern of byte-level vocabularies of 50,000 merges.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODINGS: dict = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file: a token in base 64 and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, f.read().splitlines()))}


def counter(name: str, pattern: str = PATTERN) -> Callable[[Column], Column]:
    """Tokens of a text column by a public vocabulary: the path of a ``.tiktoken`` file, or a name that ``tiktoken`` can fetch.

    Special tokens' strings are ordinary text; null texts have none. The vocabulary travels with the function.
    """
    import tiktoken

    key, ranks = name, None
    if name.endswith(".tiktoken"):
        ranks = read_ranks(name)
        key = (name, pattern, len(ranks))
    else:
        tiktoken.get_encoding(name)  # fails here rather than in a task

    @F.pandas_udf("int")
    def count(text):
        import pandas as pd

        if key not in _ENCODINGS:
            _ENCODINGS.clear()
            _ENCODINGS[key] = tiktoken.Encoding(str(key), pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if ranks else tiktoken.get_encoding(name)
        encode = _ENCODINGS[key].encode_ordinary
        return pd.Series([len(encode(s)) if isinstance(s, str) else 0 for s in text], dtype="int32")

    return count
