"""A hierarchical navigable small-world graph in flat arrays, built and searched for many points at once."""

from __future__ import annotations

from dataclasses import dataclass
from math import log

import numpy as np

from foliant.llm.kernels import U, stir


@dataclass(frozen=True)
class Shape:
    """links: neighbours of a node on a level (on the lowest: twice as many). wide: candidates while building.
    stride: nodes of the list that a step of a search expands at once."""

    links: int = 16
    wide: int = 64
    stride: int = 4
    batch: int = 256


@dataclass
class Graph:
    """points: one a row, in an order in which the nodes of a level come first. levels: from the lowest, the neighbours
    of its nodes, padded with -1."""

    points: np.ndarray
    levels: list[np.ndarray]


def level_sizes(ids: np.ndarray, links: int) -> tuple[np.ndarray, list[int]]:
    """An order of the nodes by falling level, drawn from a hash of their ids, and how many each level has."""
    u = ((stir(ids.astype(np.uint64)) >> U(11)).astype(np.float64) + 0.5) / 2**53
    level = np.floor(-np.log(u) / log(links)).astype(int)
    order = np.lexsort((ids, -level))
    sizes = [int((level >= k).sum()) for k in range(level.max(initial=0) + 1)]
    return order, sizes


def _search(points: np.ndarray, near: np.ndarray, queries: np.ndarray, entries: np.ndarray, width: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """The width best nodes found from each query's entries, best first (-1: none), and their inner products."""
    n = len(queries)
    rows = np.arange(n)[:, None]
    seen = np.zeros((n, len(points) + 1), bool)
    seen[:, -1] = True
    seen[rows, entries] = True
    entries = np.sort(entries, axis=1)
    entries[:, 1:][entries[:, 1:] == entries[:, :-1]] = -1
    ids = np.full((n, width), -1)
    sims = np.full((n, width), -np.inf)
    fresh = np.zeros((n, width), bool)
    new, active = entries, np.arange(n)
    while True:
        s = np.einsum("nmd,nd->nm", points[new], queries[active])
        s[new < 0] = -np.inf
        all_s = np.concatenate([sims[active], s], 1)
        all_i = np.concatenate([ids[active], new], 1)
        all_f = np.concatenate([fresh[active], np.ones(new.shape, bool)], 1)
        top = np.argsort(-all_s, axis=1, kind="stable")[:, :width]
        ids[active], sims[active] = np.take_along_axis(all_i, top, 1), np.take_along_axis(all_s, top, 1)
        fresh[active] = np.take_along_axis(all_f, top, 1) & (sims[active] > -np.inf)
        active = np.flatnonzero(fresh.any(1))
        if not len(active):
            return ids, sims
        pick = np.argsort(~fresh[active], axis=1, kind="stable")[:, :stride]
        wanted = np.take_along_axis(fresh[active], pick, 1)
        chosen = np.where(wanted, np.take_along_axis(ids[active], pick, 1), -1)
        fresh[active[:, None], pick] = False
        new = near[chosen]
        new[chosen < 0] = -1
        new = np.sort(new.reshape(len(active), -1), axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new[seen[active[:, None], new]] = -1
        seen[active[:, None], new] = True


def _choose(points: np.ndarray, cand: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """most of each row's candidates (best first, -1: none): those nearer to the row's point than to any that is chosen
    already, then the best of the rest."""
    n, m = cand.shape
    x = points[cand]
    among = x @ x.transpose(0, 2, 1)
    kept = np.zeros((n, m), bool)
    for c in range(m):
        free = (cand[:, c] >= 0) & (kept.sum(1) < most)
        kept[:, c] = free & ~((among[:, c, :c] >= sims[:, c, None]) & kept[:, :c]).any(1)
    order = np.argsort(np.where(kept, 0, np.where(cand >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(cand, order, 1)
    return out if out.shape[1] == most else np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def _ranked(cand: np.ndarray, sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-sims, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)


def _add_reverse(points: np.ndarray, near: np.ndarray, new: np.ndarray) -> None:
    """The chosen neighbours of new nodes get them as neighbours, and choose again where they have too many."""
    a = np.repeat(new, near.shape[1])
    b = near[new].ravel()
    a, b = a[b >= 0], b[b >= 0]
    order = np.lexsort((-np.einsum("nd,nd->n", points[a], points[b]), b))
    a, b = a[order], b[order]
    nodes, first, count = np.unique(b, return_index=True, return_counts=True)
    room = near.shape[1]
    rank = np.arange(len(b)) - np.repeat(first, count)
    fits = rank < room
    extra = np.full((len(nodes), room), -1)
    extra[np.repeat(np.arange(len(nodes)), count)[fits], rank[fits]] = a[fits]
    for k in range(0, len(nodes), 512):
        at = nodes[k : k + 512]
        cand = np.concatenate([near[at], extra[k : k + 512]], 1)
        sims = np.einsum("nmd,nd->nm", points[cand], points[at])
        sims[cand < 0] = -np.inf
        dup = (cand[:, :room, None] == extra[k : k + 512][:, None, :]).any(1) & (cand[:, room:] >= 0)
        sims[:, room:][dup] = -np.inf
        cand[:, room:][dup] = -1
        near[at] = _choose(points, *_ranked(cand, sims, 2 * room), room)


def build(points: np.ndarray, sizes: list[int], shape: Shape = Shape()) -> Graph:
    """points in the order of level_sizes(), of equal norm; levels are built from the highest down, each in batches
    that search what stands there and see each other."""
    levels: list[np.ndarray] = [np.empty(0)] * len(sizes)
    for k in range(len(sizes) - 1, -1, -1):
        size, room = sizes[k], shape.links * (1 if k else 2)
        near = np.full((size + 1, room), -1)  # the last row answers for -1
        done = 0
        while done < size:
            end = min(size, done + (shape.batch if done else min(shape.batch, 128)))
            own = np.arange(done, end)
            sims = points[own] @ points[own].T
            np.fill_diagonal(sims, -np.inf)
            cand, sims = _ranked(np.broadcast_to(own, sims.shape), sims, shape.wide)
            cand = np.where(sims > -np.inf, cand, -1)
            if done:
                entries = descend(points, levels, sizes, points[own], k, done)
                found, close = _search(points[:done], near, points[own], entries, shape.wide, shape.stride)
                cand, sims = _ranked(np.concatenate([found, cand], 1), np.concatenate([close, sims], 1), shape.wide)
            near[own] = _choose(points, cand, sims, room)
            _add_reverse(points, near, own)
            done = end
        levels[k] = near.astype(np.int32)
    return Graph(points, levels)


def descend(points: np.ndarray, levels: list[np.ndarray], sizes: list[int], queries: np.ndarray, to: int, done: int | None = None) -> np.ndarray:
    """Entries for a search on level to: the best nodes found on the level above it, from the first node down."""
    at = np.zeros((len(queries), 1), int)
    for k in range(len(sizes) - 1, to, -1):
        at = _search(points[: sizes[k]], levels[k], queries, at, 4, 1)[0]
        at = np.where(at < 0, at[:, :1], at)
    return np.where(at < done, at, 0) if done is not None else at


def search(graph: Graph, sizes: list[int], queries: np.ndarray, width: int, stride: int = 4) -> np.ndarray:
    """The width best nodes found for each query, best first; -1 where there are fewer."""
    if not len(graph.points):
        return np.full((len(queries), width), -1)
    return _search(graph.points, graph.levels[0], queries, descend(graph.points, graph.levels, sizes, queries, 0), width, stride)[0]
