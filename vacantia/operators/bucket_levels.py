"""Token-bucket arithmetic on whole numbers, for one client's run of requests.

A level is counted in units: one token is ``Quota.per_us`` units and every
microsecond adds ``Quota.tokens`` units, so no rounding ever decides a request.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Quota:
    """``tokens`` tokens every ``per_us`` microseconds, at most ``capacity`` saved up."""

    tokens: int
    per_us: int
    capacity: int

    @classmethod
    def per_minute(cls, requests: int, burst: int | None = None) -> Quota:
        return cls(requests, 60_000_000, burst or requests)

    @property
    def full(self) -> int:
        return self.capacity * self.per_us

    def refills(self, elapsed_us: np.ndarray) -> np.ndarray:
        """Units gained over each gap; negative gaps count as none."""
        longest = self.full // self.tokens + 1
        return np.clip(elapsed_us, 0, longest) * self.tokens


def spend(levels_before: list[int], gains: list[int], quota: Quota) -> tuple[np.ndarray, np.ndarray]:
    """Admit or reject requests in order.

    ``gains[i]`` is added to the running level before request ``i``; where
    ``levels_before[i]`` is not negative, a new client starts from that level.
    Returns the decisions and the level left after each.
    """
    full, token = quota.full, quota.per_us
    admitted = np.zeros(len(gains), dtype=bool)
    left = np.zeros(len(gains), dtype=np.int64)
    level = full
    for i, (start, gain) in enumerate(zip(levels_before, gains)):
        level = min(full, (level if start < 0 else start) + gain)
        if level >= token:
            level -= token
            admitted[i] = True
        left[i] = level
    return admitted, left


class LevelMap:
    """A map from an unknown starting level to the level after some requests.

    Each piece ``(low, high, moves, value)`` covers the starts ``low..high``: a
    moving piece sends them to ``value, value + 1, ...``, a fixed piece sends all
    of them to ``value``. Any run of requests has such a map, with few pieces,
    because starts that meet once stay together.
    """

    def __init__(self, pieces: list[tuple[int, int, bool, int]] = ()):
        self.pieces = []
        for piece in pieces:
            self._add(*piece)

    @classmethod
    def identity(cls, low: int, high: int) -> LevelMap:
        return cls([(low, high, True, low)])

    @classmethod
    def fixed(cls, quota: Quota, value: int) -> LevelMap:
        return cls([(0, quota.full, False, value)])

    def _add(self, low: int, high: int, moves: bool, value: int) -> None:
        """Append a piece, as part of the previous one where that can describe it."""
        if self.pieces:
            a, b, before, start = self.pieces[-1]
            expected = start + low - a if before else start
            if b + 1 == low and before == moves and value == expected:
                self.pieces[-1] = (a, high, moves, start)
                return
        self.pieces.append((low, high, moves, value))

    def _from(self, level: int) -> Iterator[tuple[int, int, bool, int]]:
        """The pieces from the one that covers ``level`` on."""
        i = bisect_right(self.pieces, level, key=lambda piece: piece[0]) - 1
        i = max(i, 0)
        while i < len(self.pieces) and self.pieces[i][1] < level:
            i += 1
        return (self.pieces[k] for k in range(i, len(self.pieces)))

    def at(self, level: int) -> int:
        i = bisect_right(self.pieces, level, key=lambda piece: piece[0]) - 1
        low, _, moves, value = self.pieces[i]
        return value + level - low if moves else value

    def after_request(self, gain: int, quota: Quota) -> LevelMap:
        """This map followed by one request that comes ``gain`` units later."""
        full, token = quota.full, quota.per_us
        result = LevelMap()
        for low, high, moves, value in self.pieces:
            value += gain
            if not moves or value >= full:
                value = min(value, full)
                result._add(low, high, False, value - token if value >= token else value)
                continue
            # Starts below ``pays`` are rejected, starts from ``fills`` on find a full bucket.
            pays, fills = low + token - value, low + full - value
            if pays > low:
                result._add(low, min(high, pays - 1), True, value)
            if pays <= high and fills > low:
                first = max(low, pays)
                result._add(first, min(high, fills - 1), True, value + first - low - token)
            if fills <= high:
                result._add(max(low, fills), high, False, full - token)
        return result

    def image(self) -> LevelMap:
        """Identity on the levels that can still occur."""
        spans = sorted((v, v + high - low if moves else v) for low, high, moves, v in self.pieces)
        merged = [spans[0]]
        for a, b in spans[1:]:
            if a <= merged[-1][1] + 1:
                merged[-1] = (merged[-1][0], max(merged[-1][1], b))
            else:
                merged.append((a, b))
        return LevelMap([(a, b, True, a) for a, b in merged])

    def then(self, later: LevelMap) -> LevelMap:
        """This map followed by ``later``, which covers this map's image."""
        result = LevelMap()
        for low, high, moves, value in self.pieces:
            if not moves:
                result._add(low, high, False, later.at(value))
                continue
            top = value + high - low
            # Pieces are in order of their starts, so those that meet are neighbours.
            for a, b, onward, target in later._from(value):
                if a > top:
                    break
                first, last = max(a, value), min(b, top)
                target = target + first - a if onward else target
                result._add(low + first - value, low + last - value, onward, target)
        return result

    def _window(self, low: int, high: int) -> LevelMap:
        """The part for starts ``low..high``, counted from ``low``."""
        window = LevelMap()
        for a, b, moves, value in self._from(low):
            if a > high:
                break
            first, last = max(a, low), min(b, high)
            target = value + first - a if moves else value
            window._add(first - low, last - low, moves, target)
        return window

    def first_token(self, quota: Quota) -> LevelMap | None:
        """The part below one token, if whole tokens at the start make no difference.

        True of any run long enough to use them up, which keeps such maps tiny.
        """
        token = quota.per_us
        first = self._window(0, token - 1)
        for k in range(1, quota.capacity):
            if self._window(k * token, (k + 1) * token - 1).pieces != first.pieces:
                return None
        return first if self.at(quota.full) == self.at(0) else None

    def turned(self, by: int, token: int) -> LevelMap:
        """The levels, all below one token, moved on by ``by`` and wrapped at the token."""
        turn = LevelMap([(0, token - by - 1, True, by)])
        if by:
            turn._add(token - by, token - 1, True, 0)
        return self.then(turn)


def map_of_run(gains: np.ndarray, quota: Quota, block: int = 256) -> LevelMap:
    """Map of a whole run; the start is the level right at the first request.

    Every ``block`` requests the map goes on from the levels still possible, and
    two shortcuts apply. If only one level is left, the rest is a plain run. If
    all are below one token, a busy stretch (no gap worth more than a token)
    rejects or admits so that the level just wraps around at one token.
    """
    token = quota.per_us
    small = np.concatenate([gains <= token, [False]])
    stretch_end = np.flatnonzero(~small)
    total = LevelMap.identity(0, quota.full)
    i = 0
    while i < len(gains):
        piece = total.image()
        lowest, highest = piece.pieces[0][0], piece.pieces[-1][1]
        if lowest == highest:
            rest = gains[i:].tolist()
            _, left = spend([lowest] + [-1] * (len(rest) - 1), rest, quota)
            return LevelMap.fixed(quota, int(left[-1]))
        if i > 0 and highest < token and quota.capacity > 1 and small[i]:
            end = int(stretch_end[np.searchsorted(stretch_end, i)])
            total = total.turned(int(gains[i:end].sum() % token), token)
            i = end
            continue
        for gain in gains[i : i + block].tolist():
            piece = piece.after_request(gain if i > 0 else 0, quota)
            i += 1
        total = total.then(piece)
    return total
