"""Which runs a read can take as they are, from a manifest alone."""

from __future__ import annotations

from strata.sources.manifest import Run


def split_plain(runs: list[Run]) -> tuple[list[Run], list[Run]]:
    """(plain, mixed): plain runs whose key range no other run of the read touches, and all the others.

    A plain run holds one live version of each of its keys, so where nothing else can hold those keys its rows need no
    shuffle to find the newest version.
    """
    plain, mixed, group, reach = [], [], [], b""
    for r in [*sorted(runs, key=lambda r: bytes.fromhex(r.lo)), None]:
        if r is None or (group and bytes.fromhex(r.lo) > reach):
            (plain if len(group) == 1 and group[0].plain else mixed).extend(group)
            group, reach = [], b""
        if r is not None:
            group.append(r)
            reach = max(reach, bytes.fromhex(r.hi))
    return plain, mixed
