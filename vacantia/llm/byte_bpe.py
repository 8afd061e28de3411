"""Byte-level BPE ids of whole texts, tokenising each stretch of text once per worker.

The pattern of byte-level BPE never lets a token cross from a non-space to white space,
so a text can be cut there; a corpus repeats most of the stretches. Stretches of letters
that every Unicode version classes alike are encoded by the faster of two installed
libraries, which share one vocabulary; all others, and texts that spell out the
end-of-text mark, by the library that defines the ids.
"""

from __future__ import annotations

import base64
import re
from array import array
from functools import cache

import numpy as np

# White space as the pattern means it, which is not quite Python's ``\s``.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_STRETCH = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_END_OF_TEXT = "<|endoftext|>"
_PLAIN_LIMIT = "\u0250"
_REMEMBERED, _LONGEST = 400_000, 200


class _Stretches(dict):
    """Number of each stretch; its ids stand in ``ids[begin[n] : begin[n] + count[n]]``."""

    def __init__(self, slow, fast):
        super().__init__()
        self.slow, self.fast = slow, fast
        self.ids, self.begin, self.count = array("I"), array("q"), array("q")

    def __missing__(self, stretch: str) -> int:
        if len(stretch) <= _LONGEST and max(stretch) < _PLAIN_LIMIT:
            ids = self.fast(stretch)
        else:
            ids = self.slow(stretch, add_special_tokens=False).ids
        number = self[stretch] = len(self.begin)
        self.begin.append(len(self.ids))
        self.count.append(len(ids))
        self.ids.extend(ids)
        return number


class ByteBpe:
    """``name`` is the vocabulary without its ending, for example ``byte_bpe_50k``."""

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        ranks = {}
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            for line in lines:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        plain = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json")).encode
        self.fast = plain.encode_ordinary
        self.known = _Stretches(self.whole, self.fast)

    @staticmethod
    @cache
    def shared(name: str) -> ByteBpe:
        return ByteBpe(name)

    def encode(self, texts: list[str], end_id: int | None = None) -> list[np.ndarray]:
        """Ids of each text, followed by ``end_id`` if there is one."""
        if len(self.known) > _REMEMBERED:
            self.known = _Stretches(self.whole, self.fast)
        found = [[] if _END_OF_TEXT in text else _STRETCH.findall(text) for text in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        number = self.known.__getitem__
        numbers = np.fromiter((number(s) for stretches in found for s in stretches), np.int64, int(sizes.sum()))
        begin, count = np.frombuffer(self.known.begin, np.int64), np.frombuffer(self.known.count, np.int64)
        counts = count[numbers]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(begin[numbers] - (ends - counts), counts)
        flat = np.frombuffer(self.known.ids, np.uint32)[at]
        cuts = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(sizes)))]
        tail = np.asarray([] if end_id is None else [end_id], np.uint32)
        out = []
        for i, text in enumerate(texts):
            own = flat[cuts[i] : cuts[i + 1]]
            if _END_OF_TEXT in text:
                own = np.asarray(self.whole(text, add_special_tokens=False).ids, np.uint32)
            out.append(np.concatenate((own, tail)))
        return out
