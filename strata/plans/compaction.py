"""Which level to compact and with which inputs, from a manifest alone."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from strata.schema import LEVELS, MAX_SEQ, Options
from strata.sources.manifest import Run, State


def scores(state: State, options: Options) -> dict[int, float]:
    """Level 0 by its number of runs, level n by its bytes against base * 10^(n-1); the last is never a source."""
    out = {0: len(state.levels[0]) / options.l0_trigger}
    for n in range(1, LEVELS - 1):
        out[n] = sum(r.size for r in state.levels[n]) / (options.base_level_bytes * 10.0 ** (n - 1))
    return out


def pick(state: State, options: Options) -> int | None:
    """The level of the greatest score of at least 1, the deeper of equals."""
    due = [(s, n) for n, s in scores(state, options).items() if s >= 1]
    return max(due)[1] if due else None


def key_range(runs: list[Run]) -> tuple[bytes, bytes]:
    return min(bytes.fromhex(r.lo) for r in runs), max(bytes.fromhex(r.hi) for r in runs)


def inputs(state: State, level: int, options: Options, oldest: int = MAX_SEQ) -> tuple[list[Run], list[Run]]:
    """Runs of the level and the runs of the next that they overlap; without the latter, runs with nothing to drop go as they are.

    All of level 0. Below it, the first run after the level's cursor, from the start again behind the last, and as many that
    follow it as the level is over its bytes: it goes down in a few steps, however many files it has. Those that can
    go down as they are and those that are to be merged go apart.
    """
    if level == 0:
        mine = list(state.levels[0])
    else:
        cursor = bytes.fromhex(state.cursors.get(str(level), ""))
        ordered = sorted(state.levels[level], key=lambda r: bytes.fromhex(r.lo))
        start = next((i for i, r in enumerate(ordered) if bytes.fromhex(r.lo) > cursor), 0)
        over = sum(r.size for r in ordered) - options.base_level_bytes * 10 ** (level - 1)
        before = accumulate((r.size for r in ordered[start:]), initial=0)
        mine = [r for r, taken in zip(ordered[start:], before) if not taken or taken <= over]
        free = [done and gap for done, gap in zip(nothing_to_drop(mine, oldest), apart(mine, state.levels[level + 1]))]
        if free[0]:
            return mine[: free.index(False)] if False in free else mine, []
        mine = mine[: len(free) - free[::-1].index(False)]
    lo, hi = key_range(mine)
    return mine, [r for r in state.levels[level + 1] if r.overlaps(lo, hi)]


def nothing_to_drop(runs: list[Run], oldest: int) -> list[bool]:
    """Whether a merge of each run by itself would give the run again, as long as the oldest snapshot is at `oldest`."""
    return [r.plain or r.settled >= oldest for r in runs]


def apart(runs: list[Run], below: tuple[Run, ...]) -> list[bool]:
    """Whether each run meets none of the runs below, which are disjoint and in order."""
    lows, highs = ([bytes.fromhex(getattr(r, end)) for r in below] for end in ("lo", "hi"))
    return [bisect_left(highs, bytes.fromhex(r.lo)) == bisect_right(lows, bytes.fromhex(r.hi)) for r in runs]


def deeper_ranges(state: State, level: int, lo: bytes, hi: bytes) -> list[tuple[bytes, bytes]]:
    """Key ranges of the runs below a level that meet [lo, hi]: tombstones there still shadow something."""
    return [(bytes.fromhex(r.lo), bytes.fromhex(r.hi)) for n in range(level + 1, LEVELS) for r in state.levels[n] if r.overlaps(lo, hi)]
