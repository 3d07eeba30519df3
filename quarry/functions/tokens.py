"""Tokenizers for ``context.count_tokens``.

The default count is white-space words (native, no Python).  A byte-level BPE
table in the tiktoken file format can be plugged in; it is loaded lazily once
per Python worker and applied to whole Arrow batches.
"""

from __future__ import annotations

# Fixed value: the published GPT-2 pre-tokenisation pattern used with 50k byte-level BPE tables.
GPT2_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class BpeTokenizer:
    """Byte-level BPE from a local ``.tiktoken`` ranks file (no network)."""

    def __init__(self, path: str, pattern: str = GPT2_PATTERN, name: str = "local-bpe"):
        self.path, self.pattern, self.name = path, pattern, name
        self._enc = None

    def __getstate__(self):
        return {"path": self.path, "pattern": self.pattern, "name": self.name}

    def __setstate__(self, state):
        self.__init__(**state)

    def _encoding(self):
        if self._enc is None:
            import tiktoken
            from tiktoken.load import load_tiktoken_bpe

            self._enc = tiktoken.Encoding(name=self.name, pat_str=self.pattern,
                                          mergeable_ranks=load_tiktoken_bpe(self.path), special_tokens={})
        return self._enc

    def encode(self, text: str) -> list[int]:
        return self._encoding().encode_ordinary(text)
