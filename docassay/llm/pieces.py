"""Looking up the ids of a text's words instead of encoding each of them again.

The pre-tokenizer's pattern never joins what a single space between two other characters divides, so a text
whose spaces are all of that kind is the chain of its space-led chunks, each encoded by itself. New chunks are
encoded many at a time, as one text: only the first token of a chunk begins with a space, which tells where it
starts. Other texts, and those that hold a special token of the library, are encoded whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Encode = Callable[[list[str]], list[bytes]]


class Chunks(dict):
    """Space-led chunk -> its ids as little-endian u32, filled in batches and emptied beyond ``limit`` entries.

    ``encode`` gives the ids of texts; ``leads`` tells for each id whether its token begins with a space;
    ``special`` are strings that ``encode`` doesn't treat as text. ``None`` stands for a chunk that can't be cut
    off by itself.
    """

    def __init__(self, encode: Encode, leads: np.ndarray, special: tuple[str, ...] = (), limit: int = 900_000):
        super().__init__()
        self.encode, self.leads, self.special, self.limit = encode, leads, special, limit
        self.wanted: list[str] = []

    def __missing__(self, chunk: str) -> bytes:
        self.wanted.append(chunk)
        return b""

    def _learn(self, chunks: list[str]) -> None:
        plain = [c for c in chunks if c and not c[0].isspace() and not c[-1].isspace()]
        if len(plain) < len(chunks):
            self.update(dict.fromkeys(set(chunks).difference(plain)))
        for at in range(0, len(plain), 512):
            part = plain[at : at + 512]
            (raw,) = self.encode([" " + " ".join(part)])
            starts = (4 * np.flatnonzero(self.leads[np.frombuffer(raw, "<u4")])).tolist()
            if len(starts) != len(part):
                raise ValueError("the tokenizer doesn't keep space-led chunks apart")
            self.update(zip(part, map(raw.__getitem__, map(slice, starts, [*starts[1:], len(raw)]))))

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        out, open_, heads = [b""] * len(texts), [], []
        for i, text in enumerate(texts):
            first, *rest = text.split(" ")
            if rest and first and not first[-1].isspace() and not any(x in text for x in self.special):
                open_.append((i, rest))
                heads.append(first)
            else:
                heads.append(text)
        if len(self) > self.limit:
            self.clear()
        while open_:  # a text that meets new chunks comes again once all of the batch are learnt
            again = []
            for i, rest in open_:
                known = len(self.wanted)
                try:
                    out[i] = b"".join(map(self.__getitem__, rest))
                except TypeError:  # a None among them: no chain
                    out[i], heads[i] = b"", texts[i]
                    continue
                if len(self.wanted) > known:
                    again.append((i, rest))
            self._learn(list(dict.fromkeys(self.wanted)))
            self.wanted.clear()
            open_ = again
        return [head + tail for head, tail in zip(self.encode(heads), out)]
