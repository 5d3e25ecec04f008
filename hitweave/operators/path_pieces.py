"""Long paths of whole pieces of a graph, each held by one task: a small event, or a weak component of a large one.

The same paths as the rounds of :mod:`.paths`: of each length only the greatest way to a
station is kept, a station being a hit off all cycles or a simple way through a strongly
connected component.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Edges of a piece that a task takes whole, and simple ways through cycles that it lists for one piece.
PIECE_EDGES = 1 << 15
PIECE_WAYS = 1 << 16
#: Rows of a batch of results.
OUT_ROWS = 1 << 13
SCHEMA = "event_id bigint, piece bigint, hit_id bigint, path array<bigint>, first bigint"

#: Paths of at most this many edges; for longer ones a piece is smaller, as a hit may have a way of every length.
SHORT = 32

Ways = dict[int, tuple]  # the greatest way of each number of hits


def piece_edges(max_edges: int | None) -> int:
    """The most edges of a piece."""
    return PIECE_EDGES if max_edges is not None and max_edges <= SHORT else PIECE_EDGES >> 6


def strong_parts(after: dict[int, list[int]], hits: Iterable[int]) -> list[list[int]]:
    """Strongly connected components, each after all that it leads to (Tarjan)."""
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    stack: list[int] = []
    open_: set[int] = set()
    found = []
    for root in hits:
        todo = [] if root in index else [(root, None)]
        while todo:
            v, rest = todo.pop()
            if rest is None:
                index[v] = low[v] = len(index)
                stack.append(v)
                open_.add(v)
                rest = iter(after.get(v, ()))
            for w in rest:
                if w not in index:
                    todo += [(v, rest), (w, None)]
                    break
                if w in open_:
                    low[v] = min(low[v], low[w])
            else:
                if low[v] == index[v]:
                    part = [stack.pop()]
                    while part[-1] != v:
                        part.append(stack.pop())
                    open_.difference_update(part)
                    found.append(part)
                if todo:
                    parent = todo[-1][0]
                    low[parent] = min(low[parent], low[v])
    return found


def _greatest(several: Iterable[Ways]) -> Ways:
    best: Ways = {}
    for ways in several:
        for n, way in ways.items():
            if n not in best or way > best[n]:
                best[n] = way
    return best


def _ways_through(part: list[int], after: dict, entries: list[int], exits: set[int], most: int, limit: int) -> list[tuple] | None:
    """The simple ways of at most ``most`` hits from an entry to an exit; None if more than ``limit`` have to be listed."""
    inside, found, front = set(part), [], [(h,) for h in entries]
    while front:
        way = front.pop()
        if way[-1] in exits:
            found.append(way)
        if len(way) < most:
            front += [(*way, w) for w in after[way[-1]] if w in inside and w not in way]
        limit -= 1
        if limit < len(front):
            return None
    return found


def piece_paths(pairs: Iterable[tuple[int, int]], min_nodes: int, max_edges: int | None, limit: int) -> dict[int, tuple | None] | None:
    """Every hit of the edges with its last long path or None; no result where more than ``limit`` ways had to be listed."""
    after: dict[int, list[int]] = {}
    before: dict[int, list[int]] = {}
    for a, b in set(pairs):
        after.setdefault(a, []).append(b)
        before.setdefault(b, []).append(a)
    label: dict[int, tuple | None] = dict.fromkeys([*after, *before])
    most = len(label) if max_edges is None else max_edges + 1
    parts = strong_parts(after, label)
    part_of = {h: i for i, part in enumerate(parts) for h in part}

    def outside(neighbours: dict, h: int) -> list[int]:
        return [w for w in neighbours.get(h, ()) if part_of[w] != part_of[h]]

    stations = []
    for part in parts:
        ways = [tuple(part)]
        if len(part) > 1:
            entries = [h for h in part if outside(before, h)]
            ways = _ways_through(part, after, entries, {h for h in part if outside(after, h)}, most, limit)
            if ways is None:
                return None
            limit -= len(ways)
        stations.append(ways)
    into: dict[tuple, Ways] = {}
    out: dict[tuple, Ways] = {}
    to_exit: dict[int, Ways] = {}
    from_entry: dict[int, Ways] = {}
    for ways in reversed(stations):
        arrived = {h: _greatest(to_exit[w] for w in outside(before, h) if w in to_exit) for h in {way[0] for way in ways}}
        for way in ways:
            own = {n + len(way): w + way for n, w in arrived[way[0]].items() if n + len(way) <= most}
            into[way] = own if way[0] in before else {1: way}
        for way in ways:
            to_exit[way[-1]] = _greatest([to_exit.get(way[-1], {}), into[way]])
    for ways in stations:
        left = {h: _greatest(from_entry[w] for w in outside(after, h) if w in from_entry) for h in {way[-1] for way in ways}}
        for way in ways:
            own = {n + len(way): way + w for n, w in left[way[-1]].items() if n + len(way) <= most}
            out[way] = own if way[-1] in after else {1: way}
        for way in ways:
            from_entry[way[0]] = _greatest([from_entry.get(way[0], {}), out[way]])
    for way, prefixes in into.items():
        both = ((p, s) for p in prefixes.values() for s in out[way].values() if min_nodes <= len(p) + len(s) - len(way) <= most)
        best = max(both, default=None)
        if best:
            path = best[0] + best[1][len(way) :]
            for h in way:
                label[h] = max(label[h] or path, path)
    return label


def _pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows (event, piece, src, dst) of one piece after another, from batches in order of the pieces."""
    rest = np.empty((4, 0), dtype=np.int64)
    for batch in batches:
        rest = np.concatenate([rest, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])], axis=1)
        changes = np.flatnonzero((rest[:2, 1:] != rest[:2, :-1]).any(axis=0)) + 1
        *whole, rest = np.split(rest, changes, axis=1)
        yield from whole
    if rest.shape[1]:
        yield rest


def label_pieces(min_nodes: int, max_edges: int | None, limit: int):
    """For tasks that hold whole pieces: (event, piece, hit, path, least hit with that path); a piece given up has one row without a hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for event, piece, src, dst in _pieces_of(batches):
            label = piece_paths(zip(src.tolist(), dst.tolist()), min_nodes, max_edges, limit)
            key = (int(event[0]), int(piece[0]))
            if label is None:
                rows.append((*key, None, None, None))
            else:
                first: dict[tuple | None, int | None] = {None: None}
                rows += [(*key, h, label[h], first.setdefault(label[h], h)) for h in sorted(label)]
            if len(rows) >= OUT_ROWS:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
    names = ["event_id", "piece", "hit_id", "path", "first"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
