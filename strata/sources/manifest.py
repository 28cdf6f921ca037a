"""Immutable manifest states: strict JSON with a checksum, installed under ever new version numbers.

A manifest file has a whole state or only what changed since the version before, so a commit writes what it did, not all
that a store holds; every FULL_EVERY-th version is whole, which bounds how many files a state is read from.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import asdict, dataclass, field, fields, replace

from strata.errors import ConflictError, CorruptionError
from strata.schema import LEVELS, MAX_SEQ

FOLDER = "manifest"
FULL_EVERY = 32


@dataclass(frozen=True)
class Run:
    """One sorted run or file: where it is, what it weighs, which keys (hex) and seqs it holds.

    A plain run holds one version of each key and no tombstone. A run settled to a sequence number has nothing that can be
    dropped while the oldest snapshot is no newer: all that came later, one version of each key before, no tombstone before.
    """

    num: int
    path: str
    size: int
    entries: int
    lo: str
    hi: str
    min_seq: int
    max_seq: int
    plain: bool = False
    settled: int = 0

    def meets(self, lower: bytes | None, upper: bytes | None) -> bool:
        """Whether its keys can lie in [lower, upper)."""
        return (lower is None or bytes.fromhex(self.hi) >= lower) and (upper is None or bytes.fromhex(self.lo) < upper)

    def overlaps(self, lo: bytes, hi: bytes) -> bool:
        return bytes.fromhex(self.lo) <= hi and bytes.fromhex(self.hi) >= lo


@dataclass(frozen=True)
class State:
    """What a store holds: unflushed deltas in order, levels of runs, and the last batch of each stream."""

    version: int = 0
    next_num: int = 1
    last_seq: int = 0
    tail: tuple[Run, ...] = ()
    levels: tuple[tuple[Run, ...], ...] = ((),) * LEVELS
    streams: dict = field(default_factory=dict)
    cursors: dict = field(default_factory=dict)

    def runs(self) -> list[Run]:
        return [*self.tail, *(r for level in self.levels for r in level)]

    def changed(self, **kw) -> State:
        return replace(self, version=self.version + 1, **kw)


def sealed(raw: dict) -> str:
    body = json.dumps(raw, sort_keys=True)
    return json.dumps({"body": body, "crc": zlib.crc32(body.encode())})


def encode(state: State) -> str:
    return sealed(asdict(state))


def encode_change(before: State, state: State) -> str | None:
    """What leads from one state to the next version, or None if it can't be told by runs that went and runs that came."""
    old, new = {r.num: r for r in before.runs()}, {r.num: r for r in state.runs()}
    came = lambda runs: [asdict(r) for r in runs if old.get(r.num) != r]
    raw = {n: getattr(state, n) for n in ("version", "next_num", "last_seq", "streams", "cursors")}
    raw |= {"gone": sorted(n for n, r in old.items() if new.get(n) != r), "tail": came(state.tail), "levels": [came(x) for x in state.levels]}
    return sealed(raw) if state.version == before.version + 1 and applied(before, raw) == state else None


def applied(before: State, raw: dict) -> State:
    """The state that a change makes of the one before: runs that came stand behind the others, below level 0 by their keys."""
    gone, run = set(raw["gone"]), lambda d: Run(**d)
    stay = lambda runs, came: (*(r for r in runs if r.num not in gone), *map(run, came))
    levels = [stay(x, came) for x, came in zip(before.levels, raw["levels"], strict=True)]
    levels[1:] = [tuple(sorted(x, key=lambda r: bytes.fromhex(r.lo))) for x in levels[1:]]
    kept = {n: raw[n] for n in ("version", "next_num", "last_seq", "streams", "cursors")}
    return State(**kept, tail=stay(before.tail, raw["tail"]), levels=tuple(levels))


def opened(text: str) -> dict:
    """The body of an encoded state or change; anything odd about it is corruption."""
    try:
        outer = json.loads(text)
        if set(outer) != {"body", "crc"} or zlib.crc32(outer["body"].encode()) != outer["crc"]:
            raise ValueError("checksum")
        raw = json.loads(outer["body"])
        names = {f.name for f in fields(State)}
        if set(raw) not in (names, names | {"gone"}) or len(raw["levels"]) != LEVELS:
            raise ValueError("fields")
        return raw
    except (ValueError, TypeError, KeyError, AttributeError) as e:
        raise CorruptionError(f"manifest: {e}") from e


def decode(*texts: str) -> State:
    """The state of a whole manifest and the changes after it, in order; anything odd about them is corruption."""
    bodies = [opened(t) for t in texts]
    try:
        state = State(levels=((),) * LEVELS)
        for i, raw in enumerate(bodies):
            if ("gone" in raw) != (i > 0) or i and raw["version"] != state.version + 1:
                raise ValueError("order of versions")
            state = applied(state, raw) if i else applied(state, raw | {"gone": []})
        for r in state.runs():
            if not r.lo or bytes.fromhex(r.lo) > bytes.fromhex(r.hi) or r.entries < 1 or not 0 < r.min_seq <= r.max_seq <= MAX_SEQ or r.num >= state.next_num:
                raise ValueError(f"run {r.num}")
        return state
    except (ValueError, TypeError, KeyError, AttributeError) as e:
        raise CorruptionError(f"manifest: {e}") from e


def name_of(version: int) -> str:
    return f"{FOLDER}/v{version:010d}.json"


def install(files, state: State, before: State | None = None) -> State:
    """Publish a state; its version must be new. Nothing is deleted if this fails: the outcome may be unknown."""
    text = encode_change(before, state) if before is not None and state.version % FULL_EVERY else None
    if not files.create(name_of(state.version), text or encode(state)):
        raise ConflictError(f"version {state.version} exists")
    return state


def versions(files) -> list[int]:
    return sorted(int(n.rpartition("/v")[2][:-5]) for n in files.list(FOLDER) if n.endswith(".json"))


def chain(files, version: int) -> list[str]:
    """The texts that a version's state is read from: a whole one and the changes after it."""
    texts = [files.read(name_of(version))]
    while "gone" in opened(texts[-1]):
        version -= 1
        try:
            texts.append(files.read(name_of(version)))
        except Exception as e:  # local and Hadoop files report a missing one each in their way
            raise CorruptionError(f"manifest: version {version}: {e}") from e
    return texts[::-1]


def needed(files, wanted: set[int]) -> set[int]:
    """All versions that the wanted ones are read from."""
    return {v - i for v in wanted for i in range(len(chain(files, v)))}


def load(files, version: int | None = None) -> State | None:
    """The state of a version, by default the newest; None if there is no manifest."""
    known = versions(files)
    if version is None and not known:
        return None
    return decode(*chain(files, known[-1] if version is None else version))
