"""The public byte-level BPE, loaded once per worker process."""

from __future__ import annotations

import base64
import json
from functools import cached_property

import numpy as np


class ByteTokenizer:
    """Ids of a ``tokenizers`` file, without special tokens around a text.

    Ordinary texts are encoded by ``tiktoken`` with the same vocabulary and
    merge order, which gives the same ids several times faster; a text that
    holds the string of a special token, or that ``tiktoken`` refuses, goes
    through ``tokenizers`` itself, which a worker loads at the first such text.
    The tests compare both.
    """

    _loaded: dict[str, ByteTokenizer] = {}

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as file:
            self.special = [t["content"] for t in json.load(file).get("added_tokens", [])]
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as file:
            ranks = {base64.b64decode(k): int(v) for k, v in map(bytes.split, file)}
        self.fast = tiktoken.Encoding(
            "bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    @cached_property
    def exact(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @staticmethod
    def default_path() -> str:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.json")

    @classmethod
    def shared(cls, path: str) -> ByteTokenizer:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def encode_exact(self, text: str) -> np.ndarray:
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return self.encode_exact(text)
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        except Exception:  # the pattern engine gives up on very long runs of blanks
            return self.encode_exact(text)
