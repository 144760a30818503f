"""Cheapest repairs of message sequences: a cost table, and the least of the cheapest audits.

A repaired sequence of role initials is ``(s?(ua)+)?``, so a repair walks through four states:
nothing yet, after s, after u, after a.  A node is (place, state); an arc deletes, keeps or
reroles the message at its place, or inserts one before it, and has that edit's letter.

Sequences are cut into lanes.  All lanes of a block are worked on at once, one place a step.
Costs are (min, +) sums, so a lane is a 4 x 4 matrix for whoever chains lanes, and a lane whose
cost-to-go at its end is known can be solved alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: States, initials (others are 3), letters in ASCII order, costs.
NONE, S, U, A = range(4)
INITIALS = {"s": 0, "u": 1, "a": 2}
LETTERS = np.frombuffer(b"DIKR", np.uint8)
DELETE, INSERT, KEEP, REROLE = range(4)
REROLE_COST, DELETE_COST, INSERT_COST, CUT_COST = 3, 4, 3, 3
INF = 1 << 40
#: The state after an inserted or reroled message.
NEXT = np.array([U, U, A, U])
#: Cost from a state to the end of a sequence, and the letters of it.
AT_END = np.array([0, 2 * INSERT_COST, INSERT_COST, 0], np.int64)
TAILS = ("", "II", "I", "")


@dataclass
class Entries:
    """Messages in order, lane by lane; ``weight`` equal messages that must go are one entry."""

    initial: np.ndarray
    forced: np.ndarray
    cut: np.ndarray
    weight: np.ndarray
    lane: np.ndarray
    lanes: int

    def __post_init__(self) -> None:
        self.sizes = np.bincount(self.lane, minlength=self.lanes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        extra = CUT_COST * self.cut.astype(np.int64)
        self.delete = DELETE_COST * self.weight.astype(np.int64)

        def emit(initial: int) -> np.ndarray:
            return np.where(self.forced, INF, extra + np.where(self.initial == initial, 0, REROLE_COST))
        self.as_s = np.where(self.forced | (self.initial != 0), INF, extra)
        self.as_u, self.as_a = emit(1), emit(2)
        last = self.starts + self.sizes - 1
        #: node block after each entry: the next entry, or the lane's end
        self.after = np.arange(1, len(self.lane) + 1)
        self.after[last[self.sizes > 0]] = len(self.lane) + np.flatnonzero(self.sizes > 0)


def entries(initial: np.ndarray, forced: np.ndarray, cut: np.ndarray, copies: np.ndarray, lane: np.ndarray, lanes: int) -> Entries:
    """Entries of distinct messages: all copies but the first must go."""
    row = np.repeat(np.arange(len(lane)), 1 + (copies > 1))
    again = np.append(False, row[1:] == row[:-1]) if len(row) else np.zeros(0, bool)
    return Entries(initial[row], forced[row] | again, cut[row] & ~again, np.where(again, copies[row] - 1, 1), lane[row], lanes)


def costs(e: Entries, end: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
    """Cost-to-go at the start of every lane, for costs ``end`` (lanes x variants x states) at its end.

    ``keep`` (entries x states) takes the costs at every place of the first variant.
    """
    order = np.argsort(-e.sizes, kind="stable")
    now = end[order].copy()
    sizes, starts = e.sizes[order], e.starts[order]
    for place in range(int(sizes[0]) - 1 if len(sizes) else -1, -1, -1):
        live = int(np.searchsorted(-sizes, -place, "left"))  # lanes longer than ``place``
        at = starts[:live] + place
        v = now[:live]
        d, ks, ku, ka = (x[at][:, None] for x in (e.delete, e.as_s, e.as_u, e.as_a))
        own = v + d[:, :, None]
        to_u, to_a = v[:, :, U] + ku, v[:, :, A] + ka
        none = np.minimum(np.minimum(own[:, :, NONE], v[:, :, S] + ks), to_u)
        s, u, a = np.minimum(own[:, :, S], to_u), np.minimum(own[:, :, U], to_a), np.minimum(own[:, :, A], to_u)
        all_u, all_a = np.minimum(u, a + INSERT_COST), np.minimum(a, u + INSERT_COST)
        now[:live] = np.stack([np.minimum(none, all_u + INSERT_COST), np.minimum(s, all_u + INSERT_COST), all_u, all_a], axis=2)
        if keep is not None:
            keep[at] = now[:live, 0]
    back = np.empty_like(now)
    back[order] = now
    return back


def matrices(e: Entries) -> np.ndarray:
    """lanes x 4 x 4: least cost from a state at a lane's start to a state at its end."""
    end = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, INF), (e.lanes, 4, 4))
    return np.minimum(costs(e, end).transpose(0, 2, 1), INF)


@dataclass
class Repairs:
    """Least audits from given lanes and states: exit state, audit bytes."""

    exits: np.ndarray
    audits: list[bytes]


def _arcs(e: Entries, table: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Targets of the optimal arcs of every node, a column for each letter; -1 for none."""
    n = len(e.lane)
    then = np.concatenate([table, end])[e.after]
    arcs = np.full((4 * (n + e.lanes), 4), -1, np.int64)
    here, after = 4 * np.arange(n), 4 * e.after
    for q in range(4):
        goal = table[:, q]
        to = int(NEXT[q])
        emit, same = (e.as_a, e.initial == 2) if to == A else (e.as_u, e.initial == 1)
        used = ~e.forced & (emit + then[:, to] == goal)
        for letter, ok, target in (
                (DELETE, then[:, q] + e.delete == goal, after + q),
                (INSERT, table[:, to] + INSERT_COST == goal, here + to),
                (KEEP, used & same, after + to),
                (REROLE, used & ~same, after + to)):
            arcs[here[ok] + q, letter] = target[ok]
        if q == NONE:
            ok = ~e.forced & (e.as_s + then[:, S] == goal)
            arcs[here[ok] + q, KEEP] = after[ok] + S
    return arcs


def _select(arcs: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The letter of every node's least optimal arc, by letter and then by the rank of where it leads; 4 at an end."""
    width = int(rank.max(initial=0)) + 1
    keys = np.where(arcs >= 0, np.arange(4) * width + rank[arcs], 4 * width)
    return np.where((arcs >= 0).any(axis=1), keys.argmin(axis=1), 4)


def _follow(arcs: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """Where the selected arc leads; an end leads to itself."""
    nodes = np.arange(len(arcs))
    return np.where(letter < 4, arcs[nodes, np.minimum(letter, 3)], nodes)


def _doubled(step: np.ndarray) -> list[np.ndarray]:
    """Pointers over 1, 2, 4, ... arcs, until they all lead to an end."""
    jumps = [step]
    while (step[jumps[-1]] != jumps[-1]).any():
        jumps.append(jumps[-1][jumps[-1]])
    return jumps


def least(e: Entries, end: np.ndarray, lanes: np.ndarray, states: np.ndarray) -> Repairs:
    """The least of the cheapest audits from each (lane, state), for costs ``end`` (lanes x states) at the lanes' ends.

    After the cost table, nodes are ranked by the first 1, 2, 4, ... arcs of their audit; the ranks
    choose each node's arc, and paths are read off through the doubled pointers.
    """
    n = len(e.lane)
    table = np.empty((n, 4), np.int64)
    costs(e, end[:, None, :], table)
    arcs = _arcs(e, table, end)
    rank = np.where((arcs >= 0).any(axis=1), 1 + (arcs >= 0).argmax(axis=1), 0)
    for jump in _doubled(_follow(arcs, _select(arcs, np.zeros(len(arcs), np.int64)))):
        rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + rank[jump], return_inverse=True)[1]
    letter = _select(arcs, rank)
    jumps = _doubled(_follow(arcs, letter))
    length = (letter < 4).astype(np.int64)
    for jump in jumps:
        length = length + length[jump]
    start = np.where(e.sizes[lanes] > 0, e.starts[lanes], n + lanes) * 4 + states
    audits: list[bytes] = [b""] * len(start)
    sizes = length[start]
    weight = np.concatenate([np.repeat(e.weight, 4), np.ones(4 * e.lanes, np.int64)])
    weight = np.where(letter == INSERT, 1, weight)
    level = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
    for k in np.unique(level[sizes > 0]):  # paths of up to 2 ** k arcs
        some = np.flatnonzero((level == k) & (sizes > 0))
        nodes = start[some][:, None]
        for jump in jumps[:k]:
            nodes = np.concatenate([nodes, jump[nodes]], axis=1)
        inside = np.arange(nodes.shape[1]) < sizes[some][:, None]
        steps = nodes[inside]
        text = np.repeat(LETTERS[letter[steps]], weight[steps]).tobytes()
        cuts = np.cumsum(np.where(inside, weight[nodes], 0).sum(axis=1))
        for i, a, b in zip(some, np.concatenate([[0], cuts]), cuts):
            audits[i] = text[a:b]
    return Repairs(jumps[-1][start] % 4, audits)
