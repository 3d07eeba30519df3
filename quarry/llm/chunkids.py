"""Token ids of texts by a library's tokenizer, looked up per chunk between spaces.

A tokenizer whose tokens never reach over a space gives a text the ids of its
chunks, one after another; so the library runs once for each distinct chunk of a
task.  The store starts anew beyond ``kept`` chunks: its memory doesn't grow
with the data.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice

import numpy as np

from quarry.llm.bpe import Numbered, gather

CHUNKS_KEPT = 500_000


class ChunkIds:
    """``cut`` gives the chunks of a text, ``encode`` the ids of a list of chunks, one after another, and how many each has."""

    def __init__(self, cut: Callable[[str], list[str]], encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], kept: int = CHUNKS_KEPT):
        self.cut, self.encode, self.kept = cut, encode, kept
        self.reset()

    def reset(self) -> None:
        self.known = Numbered()
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def block(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null and empty texts have none."""
        if len(self.known) > self.kept:
            self.reset()
        known, had, rows = self.known, len(self.known), []
        for text in texts:
            chunks = self.cut(text) if text else []
            rows.append(np.fromiter(map(known.__getitem__, chunks), np.int32, len(chunks)))
        if len(known) > had:
            flat, lengths = self.encode(list(islice(known, had, None)))
            self.flat = np.concatenate((self.flat, flat))
            self.ends = np.concatenate((self.ends, np.cumsum(lengths) + self.ends[-1]))
        return [gather(self.flat, self.ends, row)[0] for row in rows]
