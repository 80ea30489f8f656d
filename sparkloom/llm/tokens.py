"""Ids of the public tokenizers for Arrow columns of text."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np

#: Characters on which the fast byte-pair encoder and the reference library are known to cut words alike.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ‐-‧€]*\Z")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def library(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def fast(path: str):
    """The same vocabulary as ranks, its special strings included."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


def byte_bpe_ids(texts, json_path: str, ranks_path: str) -> Iterator[np.ndarray]:
    """uint32 ids of each text, as the tokenizers library gives them without added special tokens; null is empty.

    Texts of common characters go through a faster encoder with the same vocabulary (a test holds both against each
    other); any other text goes through the library itself.
    """
    quick = fast(ranks_path)
    for t in texts:
        t = t or ""
        if _PLAIN.match(t):
            yield np.array(quick.encode(t, allowed_special="all"), "<u4")
        else:
            yield np.array(library(json_path).encode(t, add_special_tokens=False).ids, "<u4")
