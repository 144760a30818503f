"""A small causal self-attention language model in numpy: windows, forward, gradients, Adam.

A text's ids are cut into windows of ``SPAN`` targets.  A window's queries see their own ids so far
and all of the window before, so windows overlap and every id is scored once.  The output is a
softmax over groups of symbols and one inside the group, so a target costs about two square
roots of the vocabulary.
"""

from __future__ import annotations

import ctypes
import glob
import os
from dataclasses import dataclass

import numpy as np

SPAN, HEADS, WIDTH, HIDDEN = 16, 2, 16, 48
F4 = np.float32


def one_thread() -> None:
    """Small products gain nothing from BLAS threads, and Spark runs a task on every core already."""
    for path in glob.glob(os.path.join(os.path.dirname(os.path.dirname(np.__file__)), "numpy.libs", "*openblas*")):
        lib = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(1)


@dataclass(frozen=True)
class Windows:
    """``ids``: inputs, the symbol before each target (windows x SPAN); ``first``: begins a text."""

    ids: np.ndarray
    targets: np.ndarray
    valid: np.ndarray
    first: np.ndarray
    text: np.ndarray

    @classmethod
    def cut(cls, symbols: np.ndarray, counts: np.ndarray, begin: int) -> "Windows":
        """Windows of texts whose symbols stand in a row; ``begin`` stands before a text."""
        rows = -(-counts // SPAN)
        n = int(rows.sum())
        text = np.repeat(np.arange(len(counts)), rows)
        first = np.append(True, text[1:] != text[:-1])[:n]
        place = (np.cumsum(rows) - rows) * SPAN
        at = np.arange(len(symbols)) + np.repeat(place - (np.cumsum(counts) - counts), counts)
        targets = np.full(n * SPAN, begin, np.uint16)
        targets[at] = symbols
        valid = np.zeros(n * SPAN, bool)
        valid[at] = True
        ids = np.append(np.uint16(begin), targets[:-1])[:n * SPAN].reshape(n, SPAN)
        ids[first, 0] = begin
        return cls(ids, targets.reshape(n, SPAN), valid.reshape(n, SPAN), first, text)

    def every(self, step: int) -> np.ndarray:
        """Of each text the windows 0, ``step``, 2 * ``step``, ... and the last."""
        n = np.arange(len(self.first))
        number = n - np.maximum.accumulate(np.where(self.first, n, 0))
        return np.flatnonzero((number % step == 0) | np.append(self.first[1:], True)[:len(n)])


def balanced(weight: np.ndarray) -> np.ndarray:
    """First symbol of each group, and the number of symbols: neighbours of about equal weight, about sqrt(n) groups."""
    n = len(weight)
    want = max(1, int(np.ceil(np.sqrt(n))))
    share = np.cumsum(weight / weight.sum() + 1 / n) / 2
    number = np.minimum((share * want).astype(int), want - 1)
    return np.append(np.flatnonzero(np.append(True, number[1:] != number[:-1])), n)


def initial(starts: np.ndarray, weight: np.ndarray, seed: int = 1) -> dict[str, np.ndarray]:
    """Parameters before training; the output biases are the logs of the symbols' weights."""
    rng = np.random.default_rng(seed)
    n, g = len(weight), len(starts) - 1

    def normal(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(F4)
    mass = np.add.reduceat(weight, starts[:-1])
    near = np.zeros((HEADS, 2 * SPAN), F4)
    near[0, 1] = 2  # one head begins at the symbol before, the others look everywhere
    return {
        "embed": normal(n, WIDTH, scale=0.5), "query": normal(WIDTH, WIDTH, scale=WIDTH ** -0.5), "key": normal(WIDTH, WIDTH, scale=WIDTH ** -0.5),
        "value": normal(WIDTH, WIDTH, scale=WIDTH ** -0.5), "mix": normal(WIDTH, WIDTH, scale=WIDTH ** -0.5), "near": near,
        "in": normal(2 * WIDTH, HIDDEN, scale=(2 * WIDTH) ** -0.5), "in_bias": np.zeros(HIDDEN, F4), "out": normal(HIDDEN, WIDTH, scale=HIDDEN ** -0.5),
        "group": normal(WIDTH, g, scale=0.1), "group_bias": np.log(mass / mass.sum()).astype(F4),
        "symbol": normal(n, WIDTH, scale=0.1), "symbol_bias": (np.log(weight) - np.log(np.repeat(mass, np.diff(starts)))).astype(F4)}


_T = np.arange(SPAN)[:, None] + SPAN - np.arange(2 * SPAN)[None, :]
#: Distance from a query to a key of its two windows, and which keys are not later.
DISTANCE = np.clip(_T, 0, 2 * SPAN - 1)
LATER = _T < 0
HALF = WIDTH // HEADS
SCALE = F4(HALF ** -0.5)
#: Weights of keys are limited to this exponent; softmaxes beyond it are taken of differences to the row's maximum.
SAFE = 60
#: Columns of a place's keys, then of its values by head, each with a one after them that sums the weights.
KEYS, SEEN = WIDTH, HEADS * (HALF + 1)


def _longest(x: np.ndarray) -> float:
    """Largest norm of the rows."""
    return float(np.sqrt(np.einsum("...i,...i", x, x).max(initial=0)))


def _exp(x: np.ndarray, tame: bool) -> np.ndarray:
    """Exponentials in place, of each row up to a common factor; ``tame`` rows need none."""
    if not tame:
        x -= x.max(axis=-1, keepdims=True)
    return np.exp(x, out=x)


def _key_value(p: dict[str, np.ndarray]) -> np.ndarray:
    """One matrix to keys and values; the columns of ones are left empty."""
    value = np.zeros((WIDTH, HEADS, HALF + 1), F4)
    value[:, :, :HALF] = p["value"].reshape(WIDTH, HEADS, HALF)
    return np.concatenate([p["key"], value.reshape(WIDTH, SEEN)], axis=1)


def _split(kv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values (windows x heads x places x columns) as views; the ones are written."""
    v = kv[..., KEYS:].reshape(*kv.shape[:2], HEADS, HALF + 1)
    v[..., HALF] = 1
    return kv[..., :KEYS].reshape(*kv.shape[:2], HEADS, HALF).transpose(0, 2, 1, 3), v.transpose(0, 2, 1, 3)


def _with_ones(x: np.ndarray) -> np.ndarray:
    """Rows with a place for a one after them, on which biases ride."""
    out = np.empty((len(x), x.shape[1] + 1), F4)
    out[:, :-1] = x
    out[:, -1] = 1
    return out


class Inside:
    """Softmaxes of rows, sorted by group, over the symbols of their group: ``flat`` has row after row."""

    def __init__(self, z: np.ndarray, group: np.ndarray, targets: np.ndarray, starts: np.ndarray, table: np.ndarray, tame: bool):
        cuts, sizes = np.searchsorted(group, np.arange(len(starts))), np.diff(starts)
        rows = np.diff(cuts)
        ends = np.cumsum(rows * sizes)
        self.flat, self.parts = np.empty(int(ends[-1]), F4), []
        for g in np.flatnonzero(rows):
            x = self.flat[ends[g] - rows[g] * sizes[g]:ends[g]].reshape(rows[g], sizes[g])
            at, of = slice(cuts[g], cuts[g + 1]), slice(starts[g], starts[g + 1])
            np.matmul(z[at], table[of].T, out=x)
            if not tame:
                x -= x.max(axis=1, keepdims=True)
            self.parts.append((at, of, x))
        #: Where each row's target stands.
        self.own = (ends - rows * sizes - cuts[:-1] * sizes)[group] + np.arange(len(z)) * sizes[group] + targets - starts[group]

    def sums(self) -> np.ndarray:
        """Exponentials in place, and their sum of each row."""
        np.exp(self.flat, out=self.flat)
        out, ones = np.empty(len(self.own), F4), np.ones(max((x.shape[1] for _, _, x in self.parts), default=0), F4)
        for at, _, x in self.parts:
            np.matmul(x, ones[:x.shape[1]], out=out[at])
        return out


class Pass:
    """One forward pass over some windows; ``logp`` of their valid targets by group, and the gradients after it."""

    def __init__(self, p: dict[str, np.ndarray], starts: np.ndarray, w: Windows, some: np.ndarray):
        self.p, self.starts, self.n = p, starts, len(some)
        n = self.n
        self.ids = np.concatenate([w.ids[np.where(w.first[some], some, some - 1)], w.ids[some]], axis=1)
        use = np.flatnonzero(w.valid[some].ravel())
        targets = w.targets[some].ravel()[use].astype(np.int64)
        group = np.searchsorted(starts, targets, "right") - 1
        by_group = np.argsort(group.astype(np.uint16), kind="stable")
        self.use, self.targets, self.group = use[by_group], targets[by_group], group[by_group]
        self.x = p["embed"].take(self.ids, axis=0)
        self.own = self.x[:, SPAN:].reshape(-1, WIDTH)
        kv = (self.x.reshape(-1, WIDTH) @ _key_value(p)).reshape(n, 2 * SPAN, KEYS + SEEN)
        self.k, self.v = _split(kv)
        self.q = (self.own @ (p["query"] * SCALE)).reshape(n, SPAN, HEADS, HALF).transpose(0, 2, 1, 3)
        s = np.matmul(self.q, self.k.transpose(0, 1, 3, 2))
        if _longest(self.q) * _longest(self.k) + float(np.abs(p["near"]).max()) <= SAFE:
            np.exp(s, out=s)
            s *= np.where(LATER, 0, np.exp(p["near"][:, DISTANCE])).astype(F4)
        else:
            s += p["near"][:, DISTANCE]
            np.clip(s, -SAFE, SAFE, out=s)
            np.exp(s, out=s)
            s *= (~LATER).astype(F4)
        s[w.first[some], :, :, :SPAN] = 0
        self.att = s  # up to the sums
        seen = np.empty((n, SPAN, HEADS, HALF + 1), F4)
        np.matmul(s, self.v, out=seen.transpose(0, 2, 1, 3))
        self.sums = seen[..., HALF:]
        self.seen = seen[..., :HALF] / self.sums
        self.heads = self.seen.reshape(-1, WIDTH).take(self.use, axis=0)
        self.h = np.empty((len(self.use), 2 * WIDTH + 1), F4)
        self.h[:, :WIDTH] = self.own.take(self.use, axis=0)
        np.matmul(self.heads, p["mix"], out=self.h[:, WIDTH:-1])
        self.h[:, -1] = 1
        self.r = self.h @ np.concatenate([p["in"], p["in_bias"][None]])
        np.maximum(self.r, 0, out=self.r)
        z = self.r @ p["out"]
        z += self.h[:, :WIDTH]
        z += self.h[:, WIDTH:-1]
        self.z = _with_ones(z)
        rows = np.arange(len(z))
        tame = (_longest(z) * max(_longest(p["group"].T), _longest(p["symbol"]))
                + max(float(np.abs(p[k]).max()) for k in ("group_bias", "symbol_bias")) <= SAFE)
        self.pg = self.z @ np.concatenate([p["group"], p["group_bias"][None]])
        _exp(self.pg, tame)
        self.pg_sums = self.pg @ np.ones(self.pg.shape[1], F4)
        self.inside = Inside(self.z, self.group, self.targets, starts, np.concatenate([p["symbol"], p["symbol_bias"][:, None]], axis=1), tame)
        self.ps_sums = self.inside.sums()
        chance = self.pg[rows, self.group] / self.pg_sums * (self.inside.flat[self.inside.own] / self.ps_sums)
        self.logp = np.log(np.maximum(chance, F4(1e-30)))

    def gradients(self) -> dict[str, np.ndarray]:
        """Of the mean negative log probability; the pass is used up.  Softmaxes are divided by their sums in the narrower factor."""
        p, n, share = self.p, self.n, F4(1 / max(1, len(self.targets)))
        out = {k: np.zeros_like(p[k]) for k in ("embed", "near")}
        dg, over = self.pg, (share / self.pg_sums)[:, None]
        dg[np.arange(len(dg)), self.group] -= self.pg_sums
        both = (self.z * over).T @ dg
        out["group"], out["group_bias"] = both[:-1], both[-1]
        dz = dg @ p["group"].T
        dz *= over
        over = (share / self.ps_sums)[:, None]
        self.inside.flat[self.inside.own] -= self.ps_sums
        z, back, both = self.z * over, np.empty_like(dz), np.zeros((len(p["symbol"]), WIDTH + 1), F4)
        for at, of, ps in self.inside.parts:
            np.matmul(ps, p["symbol"][of], out=back[at])
            np.matmul(ps.T, z[at], out=both[of])
        out["symbol"], out["symbol_bias"] = both[:, :-1], both[:, -1]
        back *= over
        dz += back
        out["out"] = self.r.T @ dz
        dr = dz @ p["out"].T
        dr *= self.r > 0
        both = self.h.T @ dr
        out["in"], out["in_bias"] = both[:-1], both[-1]
        dh = dr @ p["in"].T
        dh[:, :WIDTH] += dz
        dh[:, WIDTH:] += dz
        out["mix"] = self.heads.T @ dh[:, WIDTH:]
        dheads, down = np.zeros((n * SPAN, WIDTH), F4), np.zeros((n * SPAN, WIDTH), F4)
        dheads[self.use] = dh[:, WIDTH:] @ p["mix"].T
        down[self.use] = dh[:, :WIDTH]
        # the last column meets the ones of the values: the mean over the keys is taken off
        da = np.empty((n, SPAN, HEADS, HALF + 1), F4)
        np.divide(dheads.reshape(n, SPAN, HEADS, HALF), self.sums, out=da[..., :HALF])
        np.negative(np.einsum("nthi,nthi->nth", da[..., :HALF], self.seen), out=da[..., HALF])
        da = da.transpose(0, 2, 1, 3)
        dkv = np.empty((n, 2 * SPAN, 2, HEADS, HALF), F4)
        dk, dv = (dkv[:, :, i].transpose(0, 2, 1, 3) for i in range(2))
        np.matmul(self.att.transpose(0, 1, 3, 2), da[..., :HALF], out=dv)
        ds = np.matmul(da, self.v.transpose(0, 1, 3, 2))
        ds *= self.att
        by_place = (np.ones(n, F4) @ ds.reshape(n, -1)).reshape(HEADS, SPAN, 2 * SPAN)
        for head in range(HEADS):
            out["near"][head] = np.bincount(DISTANCE[~LATER], by_place[head][~LATER], 2 * SPAN)
        dq = np.empty((n, SPAN, HEADS, HALF), F4)
        np.matmul(ds, self.k, out=dq.transpose(0, 2, 1, 3))
        np.matmul(ds.transpose(0, 1, 3, 2), self.q, out=dk)
        dq, dkv = dq.reshape(-1, WIDTH), dkv.reshape(-1, 2 * WIDTH)
        out["query"] = self.own.T @ dq * SCALE
        both = self.x.reshape(-1, WIDTH).T @ dkv
        out["key"], out["value"] = both[:, :WIDTH], both[:, WIDTH:]
        down += dq @ (p["query"].T * SCALE)
        dx = (dkv @ np.concatenate([p["key"], p["value"]], axis=1).T).reshape(n, 2 * SPAN, WIDTH)
        dx[:, SPAN:] += down.reshape(n, SPAN, WIDTH)
        order = np.argsort(self.ids.ravel(), kind="stable")
        ids = self.ids.ravel()[order]
        opens = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        out["embed"][ids[opens]] = np.add.reduceat(dx.reshape(-1, WIDTH).take(order, axis=0), opens, axis=0)
        return out


class Adam:
    def __init__(self, params: dict[str, np.ndarray]):
        self.params, self.step = params, 0
        self.first = {k: np.zeros_like(v) for k, v in params.items()}
        self.second = {k: np.zeros_like(v) for k, v in params.items()}

    def apply(self, grads: dict[str, np.ndarray], rate: float) -> None:
        self.step += 1
        size = F4(rate * np.sqrt(1 - 0.98 ** self.step) / (1 - 0.9 ** self.step))
        for k, g in grads.items():
            m, v = self.first[k], self.second[k]
            m += F4(0.1) * (g - m)
            v += F4(0.02) * (g * g - v)
            self.params[k] -= size * m / (np.sqrt(v) + F4(1e-7))


class Scorer:
    """Log probabilities of texts; what depends on a symbol alone is computed once for all symbols.

    Work goes in pieces that stay in a core's cache; the largest weights and logits that these
    parameters can give are known beforehand, so they are not looked for in every piece.
    """

    def __init__(self, p: dict[str, np.ndarray], starts: np.ndarray):
        self.p, self.starts = p, starts
        e = p["embed"]
        self.q, self.kv = e @ (p["query"] * SCALE), e @ _key_value(p)
        self.near = np.where(LATER, 0, np.exp(p["near"][:, DISTANCE])).astype(F4)
        self.tame = _longest(self.q.reshape(-1, HEADS, HALF)) * _longest(self.kv[:, :KEYS].reshape(-1, HEADS, HALF)) <= SAFE
        # biases ride on a row of ones
        self.into = np.concatenate([p["in"], p["in_bias"][None]])
        self.group = np.concatenate([p["group"], p["group_bias"][None]])
        self.symbol = np.concatenate([p["symbol"], p["symbol_bias"][:, None]], axis=1)
        self.bound = max(_longest(self.group.T), _longest(self.symbol))

    def __call__(self, w: Windows, batch: int = 768) -> np.ndarray:
        """Natural log probability of every text of ``w``: the sum over its targets, each scored in one window."""
        total = np.zeros(int(w.text.max(initial=-1)) + 1)
        for a in range(0, len(w.first), batch):
            b = min(a + batch, len(w.first))
            logp = np.zeros((b - a) * SPAN)
            use, found = self._some(w, a, b)
            logp[use] = found
            text = w.text[a:b]
            opens = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            total[text[opens]] += np.add.reduceat(logp.reshape(b - a, SPAN).sum(axis=1), opens)
        return total

    def _seen(self, w: Windows, a: int, b: int, out: np.ndarray) -> None:
        """What the heads see from every place of the windows: rows of WIDTH."""
        n = b - a
        ids = w.ids[max(a - 1, 0):b]
        if a == 0:
            ids = np.concatenate([ids[:1], ids])  # stands for the window before the first, which is not looked at
        kv = self.kv.take(ids.ravel(), axis=0)
        kv = np.lib.stride_tricks.as_strided(kv, (n, 2 * SPAN, kv.shape[1]), (SPAN * kv.strides[0], *kv.strides))  # windows overlap
        k, v = _split(kv)
        s = np.matmul(self.q.take(w.ids[a:b], axis=0).reshape(n, SPAN, HEADS, HALF).transpose(0, 2, 1, 3), k.transpose(0, 1, 3, 2))
        if not self.tame:
            np.clip(s, -SAFE, SAFE, out=s)
        np.exp(s, out=s)
        s *= self.near
        s[w.first[a:b], :, :, :SPAN] = 0
        seen = np.empty((n, SPAN, HEADS, HALF + 1), F4)
        np.matmul(s, v, out=seen.transpose(0, 2, 1, 3))
        np.divide(seen[..., :HALF], seen[..., HALF:], out=out.reshape(n, SPAN, HEADS, HALF))

    def _some(self, w: Windows, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the targets, by group, and their log probabilities."""
        p = self.p
        use = np.flatnonzero(w.valid[a:b].ravel())
        targets = w.targets[a:b].ravel()[use].astype(np.int64)
        group = np.searchsorted(self.starts, targets, "right") - 1
        order = np.argsort(group.astype(np.uint16), kind="stable")
        use, targets, group = use[order], targets[order], group[order]
        seen = np.empty(((b - a) * SPAN, WIDTH), F4)
        for i in range(a, b, 32):
            j = min(i + 32, b)
            self._seen(w, i, j, seen[(i - a) * SPAN:(j - a) * SPAN])
        symbols = w.ids[a:b].ravel()[use]
        z = np.empty((len(use), WIDTH + 1), F4)
        z[:, WIDTH] = 1
        out = np.empty(len(z), F4)
        size = 0.0
        for i in range(0, len(use), 1024):
            at = slice(i, i + 1024)
            own = p["embed"].take(symbols[at], axis=0)
            h = np.empty((len(own), 2 * WIDTH + 1), F4)
            h[:, :WIDTH], h[:, -1] = own, 1
            mixed = np.matmul(seen.take(use[at], axis=0), p["mix"], out=h[:, WIDTH:-1])
            r = h @ self.into
            np.maximum(r, 0, out=r)
            own += mixed
            own += r @ p["out"]
            z[at, :WIDTH] = own
            size = max(size, _longest(z[at]))
            out[at] = self._log(z[at] @ self.group, group[at], self.bound * size <= SAFE)
        inside = Inside(z, group, targets, self.starts, self.symbol, self.bound * size <= SAFE)
        out += inside.flat[inside.own]
        out -= np.log(inside.sums())
        return use, out

    @staticmethod
    def _log(x: np.ndarray, at: np.ndarray, tame: bool) -> np.ndarray:
        """Log of the softmax at one place of each row."""
        if not tame:
            x -= x.max(axis=1, keepdims=True)
        own = x[np.arange(len(x)), at]
        return own - np.log(np.exp(x, out=x) @ np.ones(x.shape[1], F4))
