"""Token-bucket arithmetic in whole numbers, used inside Spark tasks.

Tokens are counted in units of 1e-18, refill in units per microsecond (1e-12 tokens per
second) and time in microseconds, so a replay gives the same answer however the log is
split, without rounding drift. Between tasks the units travel as decimal(38,0), which
leaves room for capacities far above a million million tokens.
"""

from __future__ import annotations

from bisect import bisect_right

TOKEN = 10**18
DAY_US = 86_400 * 10**6  # fixed value: idle time after which shared state expires
FULL = 10**37
LONGEST = 2**63 - 1  # nanoseconds that fit a bigint


def gain(elapsed_us: int, refill: int, shared: bool) -> int:
    """Units gained in ``elapsed_us``; an expired shared bucket is full again."""
    if elapsed_us <= 0:
        return 0
    if shared and elapsed_us >= DAY_US:
        return FULL
    return elapsed_us * refill


def take(tokens: int, capacity: int, refill: int, shared: bool) -> tuple[int, bool, float, int]:
    """One request against refilled ``tokens``: (tokens, allowed, remaining, retry_ns)."""
    tokens = min(tokens, capacity)
    if tokens >= TOKEN:
        tokens -= TOKEN
        return tokens, True, tokens / TOKEN, 0
    if refill <= 0:
        wait = 10**9
    elif shared:
        wait = -((tokens - TOKEN) // (refill * 10**6)) * 10**9
    else:
        wait = -(((tokens - TOKEN) * 1000) // refill)
    return tokens, False, tokens / TOKEN if shared else 0.0, min(wait, LONGEST)


class Transfer:
    """What a run of requests does to the tokens, for every possible start at once.

    Tokens after the run are a step-wise function of the tokens before it: on each piece
    either a constant or the start plus an offset. Few pieces exist, since starts above
    the capacity meet at the capacity and starts that run dry meet at their fraction.
    """

    def __init__(self) -> None:
        self.pieces = [(0, 1, 0)]  # (first start, slope 0/1, offset)

    def request(self, gained: int, capacity: int) -> None:
        out: list[tuple[int, int, int]] = []

        def add(start: int, slope: int, offset: int) -> None:
            if out and out[-1][1:] == (slope, offset):
                return
            out.append((start, slope, offset))

        last = len(self.pieces) - 1
        for i, (start, slope, offset) in enumerate(self.pieces):
            stop = self.pieces[i + 1][0] if i < last else None
            level = offset + gained
            if not slope:
                add(start, 0, self._used(min(level, capacity)))
                continue
            # starts below ``dry`` are refused, below ``brim`` they stay under the capacity
            dry, brim = TOKEN - level, capacity - level
            if start < min(dry, brim):
                add(start, 1, level)
            paid = max(start, dry)
            if paid < brim and (stop is None or paid < stop):
                add(paid, 1, level - TOKEN)
            capped = max(start, brim)
            if stop is None or capped < stop:
                add(capped, 0, self._used(capacity))
        self.pieces = out

    @staticmethod
    def _used(tokens: int) -> int:
        return tokens - TOKEN if tokens >= TOKEN else tokens


def apply_pieces(starts, slopes, offsets, tokens: int) -> int:
    i = bisect_right(starts, tokens) - 1
    return int(offsets[i]) + (tokens if slopes[i] else 0)
