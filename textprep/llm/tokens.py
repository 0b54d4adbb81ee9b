"""Token ids of a public byte-level BPE inside tasks.

The pre-tokenizer's pattern looks ahead for runs of white space only. Texts without such runs are
cut by the same pattern without that alternative, which needs no backtracking. Strings that name
special tokens are ordinary text, unless the tokens are given as ``added``: then texts are split at them
first, as the other library does, and they get their ids.
"""

from __future__ import annotations

import base64
import json
import os
import re
from array import array

import numpy as np
import public_tokenizers
import tiktoken

LOOKAHEAD = r"|\s+(?!\S)"
SPACE_RUN = re.compile(r"\s\s")


def default_path() -> str:
    """Ranks of the vocabulary that ``byte_bpe_50k.json`` holds for another library."""
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def added_tokens(path: str) -> dict[str, int]:
    """Ids of the added tokens in the JSON file beside the ranks, by their strings."""
    path = os.path.splitext(path)[0] + ".json"
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


class Encoder:
    def __init__(self, path: str, added: dict[str, int] | None = None) -> None:
        self.added = added or {}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.splits = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(t): int(n) for t, n in (line.split() for line in lines)}
        self.whole, self.plain = (
            tiktoken.Encoding("corpus", pat_str=p, mergeable_ranks=ranks, special_tokens={})
            for p in (public_tokenizers.PATTERN, public_tokenizers.PATTERN.replace(LOOKAHEAD, ""))
        )

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text as unsigned 32-bit integers."""
        if self.splits is None or not self.splits.search(text):
            return self.ordinary(text)
        parts = self.splits.split(text)  # every other one is an added token
        ids = [np.array([self.added[t]], "u4") if i % 2 else self.ordinary(t) for i, t in enumerate(parts)]
        return np.concatenate(ids)

    def ordinary(self, text: str) -> np.ndarray:
        encoding = self.whole if SPACE_RUN.search(text) else self.plain
        return np.frombuffer(array("I", encoding.encode_ordinary(text)), "u4")
