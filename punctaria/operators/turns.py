"""Turns of ``club`` in blocks: who stops being clustered, who is whose friend then, and the best rank that reaches each point.

A point's turn only takes ranks on to its friends, and ranks only fall. So a block goes through all its turns at once with what others have told it of groups that lie in several blocks, and goes
through them again where they tell it of a better rank; the ranks that no block can better are those of going point by point.
"""

from __future__ import annotations

import itertools
import statistics

import numpy as np
import pyarrow as pa

#: A block as one row: its points in order of their turns (r, pid), friends up to the first that is not clustered (``nn``: places among them, beyond their number places in ``far``) where each list ends, their
#: distances if ``jumps`` says so of any, and who lives in other blocks, and where.
PACKED = "block int, r binary, pid binary, ends binary, nn binary, dist binary, jumps binary, far array<bigint>, far_block array<int>"
#: A block's groups as one row, and (block, g, members) for what groups of others hold of a block.
GROUPS = "block int, n int, r binary, pid binary, stays binary, turns binary, ends binary, members binary, shared binary, g bigint, others array<bigint>"
_NEVER = 1 << 62


def until_jump(dist: list[float], least: int) -> int:
    """How many friends there are up to the first jump in their distances that stands out, if more than ``least`` do."""
    steps = [b - a for a, b in itertools.pairwise(dist)]
    if not steps:
        return len(dist)
    mid = statistics.median(steps)
    off = [abs(s - mid) for s in steps]
    spread = statistics.median(off)
    out = [i for i, o in enumerate(off) if o > 5 * spread * spread] if spread else []
    return out[0] + 1 if len(out) > least else len(dist)


def packed(block: int, r: np.ndarray, pid: np.ndarray, jumps: np.ndarray, item: np.ndarray, nn: np.ndarray, nn_block: np.ndarray, dist: np.ndarray) -> pa.Table:
    """The row ``PACKED`` of a block's points (r, pid, jumps); ``nn`` are the turns of friends of ``item``, in order of item and rank."""
    by = np.argsort(r)
    place = np.empty(len(r), np.int64)
    place[by] = np.arange(len(r))
    order = np.argsort(place[item], kind="stable")
    item, nn, nn_block, dist = place[item][order], nn[order], nn_block[order], dist[order]
    r, pid, jumps = r[by], pid[by], jumps[by]
    at = np.minimum(np.searchsorted(r, nn), len(r) - 1)
    away = r[at] != nn
    far, first, code = np.unique(nn[away], return_index=True, return_inverse=True)
    at[away] = len(r) + code
    ends = np.cumsum(np.bincount(item, minlength=len(r)))
    data = [_bytes(r, np.int64), _bytes(pid, np.int64), _bytes(ends, np.int32), _bytes(at, np.int32), _bytes(dist if jumps.any() else dist[:0], np.float64), _bytes(jumps, np.uint8)]
    values = [pa.array([block], pa.int32()), *(pa.array([d], pa.binary()) for d in data), pa.array([far.tolist()], pa.list_(pa.int64())), pa.array([nn_block[away][first].tolist()], pa.list_(pa.int32()))]
    table = pa.Table.from_arrays(values, ["block", "r", "pid", "ends", "nn", "dist", "jumps", "far", "far_block"])
    return table.slice(0, min(len(r), 1))  # no row without points


def _bytes(values: np.ndarray, kind: type) -> bytes:
    return np.ascontiguousarray(values, kind).tobytes()


def _array(table: pa.Table, name: str, kind: type, row: int = 0) -> np.ndarray:
    return np.frombuffer(table[name][row].as_py(), kind)


def _fallen(r: np.ndarray, ends: np.ndarray, nn: np.ndarray, far: np.ndarray, told: np.ndarray, least: int) -> np.ndarray:
    """Whether each point of a block, then each of ``far``, stops being clustered, ``told`` being who does of others: those with too few friends, and those with one among the first ``least`` who did so before them."""
    n = len(r)
    out = np.r_[np.diff(np.r_[0, ends]) < least, np.isin(far, told)]
    if least > 0:
        others = np.flatnonzero(~out[:n])
        first = nn[(ends - np.diff(np.r_[0, ends]))[others, None] + np.arange(least)]
        before = np.r_[r, far][first] < r[others, None]
        while True:
            new = (out[first] & before).any(1) & ~out[others]
            if not new.any():
                break
            out[others[new]] = True
    return out


def _opened(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The packed row of a block, its arrays, and who has been told of."""
    row = table.filter(table["r"].is_valid())
    told = table["told"].drop_null().to_numpy() if "told" in table.column_names else np.zeros(0, np.int64)
    return row, _array(row, "r", np.int64), _array(row, "ends", np.int32).astype(np.int64), _array(row, "nn", np.int32), np.array(row["far"][0].as_py(), np.int64), told


def fallen_of(table: pa.Table, least: int) -> pa.Table:
    """(r) of points of a block that stop being clustered."""
    _, r, ends, nn, far, told = _opened(table)
    return pa.table({"r": r[_fallen(r, ends, nn, far, told, least)[: len(r)]]})


def grouped(table: pa.Table, least: int) -> pa.Table:
    """Rows ``GROUPS`` of a block: each point that stays clustered with those friends that precede the first one who is not clustered any more at its turn."""
    row, r, ends, nn, far, told = _opened(table)
    n, start = len(r), np.r_[0, ends[:-1]]
    out = _fallen(r, ends, nn, far, told, least)
    item = np.repeat(np.arange(n), ends - start)
    gone = np.cumsum(np.r_[0, out[nn] & (np.r_[r, far][nn] < r[item])])
    keep = (gone[1:] == gone[start[item]]) & ~out[item]
    jumps = _array(row, "jumps", np.uint8).astype(bool)
    if jumps.any():
        dist, held = _array(row, "dist", np.float64), np.bincount(item[keep], minlength=n)
        cut = held.copy()
        for i in np.flatnonzero(jumps & ~out[:n]).tolist():
            cut[i] = until_jump(dist[start[i] : start[i] + held[i]].tolist(), least)
        keep &= np.arange(len(nn)) - start[item] < cut[item]
    turns = np.flatnonzero(~out[:n])
    here, there = keep & (nn < n), keep & (nn >= n)
    # A group is its point, then its friends of this block.
    members = np.r_[turns, nn[here]]
    of = np.r_[turns, item[here]]
    members = members[np.argsort(of, kind="stable")]
    ends = np.cumsum(np.bincount(of, minlength=n)[turns])
    shared = np.bincount(item[there], minlength=n)[turns] > 0
    data = [_bytes(r, np.int64), row["pid"][0].as_py(), _bytes(~out[:n], np.uint8), _bytes(turns, np.int32), _bytes(ends, np.int32), _bytes(members, np.int32), _bytes(shared, np.uint8)]
    to = np.array(row["far_block"][0].as_py(), np.int64)[nn[there] - n]
    g, who = r[item[there]], far[nn[there] - n]
    by = np.lexsort((g, to))
    to, g, who = to[by], g[by], who[by]
    new = np.flatnonzero(np.r_[True, (to[1:] != to[:-1]) | (g[1:] != g[:-1])]) if len(g) else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[np.zeros(1), new, [len(g)]].astype(np.int32)), pa.array(who, pa.int64()))  # an empty one for the block's own row
    none = [None] * len(new)
    first = [pa.array([int(row["block"][0].as_py()), *to[new].tolist()], pa.int32()), pa.array([n, *none], pa.int32())]
    values = [*first, *(pa.array([d, *none], pa.binary()) for d in data), pa.array([None, *g[new].tolist()], pa.int64()), lists]
    return pa.Table.from_arrays(values, ["block", "n", "r", "pid", "stays", "turns", "ends", "members", "shared", "g", "others"])


def _segments(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of runs, one after another."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def _swept(table: pa.Table) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, list]:
    """All turns of some blocks in order, with what is known of groups that reach beyond: rows of blocks with their places, (block, g) of shared groups and the ranks they give, and the ranks that points hold in the end."""
    rows = table.filter(table["r"].is_valid())
    own, offset, held, time, size, flat, shared = [], 0, [], [], [], [], []
    where = {}
    for k in range(len(rows)):
        r, turns, ends = _array(rows, "r", np.int64, k), _array(rows, "turns", np.int32, k), _array(rows, "ends", np.int32, k).astype(np.int64)
        block = rows["block"][k].as_py()
        where[block] = offset, r
        own.append((k, offset, len(r)))
        held.append(r)
        time.append(r[turns])
        size.append(np.diff(np.r_[0, ends]))
        flat.append(_array(rows, "members", np.int32, k).astype(np.int64) + offset)
        far = r[turns[_array(rows, "shared", np.uint8, k).astype(bool)]]
        shared.append(np.stack([np.full(len(far), block), far], 1))
        offset += len(r)
    spans = table.filter(table["others"].is_valid()).select(["block", "g", "others"])
    spans = spans.filter(spans["g"].is_valid()).combine_chunks()
    if len(spans):
        block, g = spans["block"].to_numpy().astype(np.int64), spans["g"].to_numpy()
        lists = spans["others"].combine_chunks() if isinstance(spans["others"], pa.ChunkedArray) else spans["others"]
        many = np.asarray(lists.value_lengths()).astype(np.int64)
        who, at = lists.flatten().to_numpy(), np.repeat(block, many)
        place = np.empty(len(who), np.int64)
        for b in np.unique(block).tolist():
            first, r = where[b]
            place[at == b] = first + np.searchsorted(r, who[at == b])
        time.append(g)
        size.append(many)
        flat.append(place)
        shared.append(np.stack([block, g], 1))
    time, size, flat, shared = np.concatenate(time), np.concatenate(size), np.concatenate(flat), np.concatenate(shared)
    by = np.argsort(time, kind="stable")
    flat = flat[_segments((np.cumsum(size) - size)[by], size[by])].tolist()
    time, ends = time[by], np.cumsum(size[by])
    last = np.flatnonzero(np.r_[time[1:] != time[:-1], True]) if len(time) else np.zeros(0, np.int64)  # parts of a group are one
    time, ends = time[last], ends[last]
    limit = np.full(len(time), _NEVER)
    known = table.filter(table["val"].is_valid()) if "val" in table.column_names else table.slice(0, 0)
    if len(known):
        np.minimum.at(limit, np.searchsorted(time, known["g"].to_numpy()), known["val"].to_numpy())
    holds, gives, start = np.concatenate(held).tolist(), [], 0
    get = holds.__getitem__
    for end, most in zip(ends.tolist(), limit.tolist(), strict=True):
        group = flat[start:end]
        best = min(map(get, group))
        if most < best:
            best = most
        for v in group:
            holds[v] = best
        gives.append(best)
        start = end
    shared = np.unique(shared, axis=0)
    given = np.array(gives, np.int64)[np.searchsorted(time, shared[:, 1])] if len(shared) else np.zeros(0, np.int64)
    return [(rows, *o) for o in own], shared[:, 0], shared[:, 1], given, holds


def said(table: pa.Table) -> pa.Table:
    """(block, g, val) of groups that lie in several blocks: the ranks that they give as far as these blocks know."""
    _, block, g, val, _ = _swept(table)
    return pa.table({"block": pa.array(block, pa.int32()), "g": pa.array(g, pa.int64()), "val": pa.array(val, pa.int64())})


def held(table: pa.Table) -> pa.Table:
    """(pid, holds) of points that stay clustered."""
    own, *_, holds = _swept(table)
    pids, ranks = [], []
    for rows, k, offset, n in own:
        stays = _array(rows, "stays", np.uint8, k).astype(bool)
        pids.append(_array(rows, "pid", np.int64, k)[stays])
        ranks.append(np.array(holds[offset : offset + n], np.int64)[stays])
    return pa.table({"pid": np.concatenate(pids), "holds": np.concatenate(ranks)})


def tasks(sizes: dict[int, int], most: int, odd: bool) -> list[tuple[int, int]]:
    """(block, task) for blocks with their numbers of points: blocks next to each other are taken together, up to ``most`` points, at other places every other time."""
    out, task, held = [], 0, most // 2 if odd and sum(sizes.values()) > most else 0
    for block, n in sorted(sizes.items()):
        if held and held + n > most:
            task, held = task + 1, 0
        out.append((block, task))
        held += n
    return out
