"""Forests of many streams side by side: the n-th rows of all streams are one step of numpy.

A forest's row costs some hundred microseconds in plain numbers. Streams don't know of each other, so a step here does for all forests what
``ForestRegressor`` does for one, in the same order of sums and draws: the results are equal. Nodes of all trees lie in arrays; leaves
hold numbers of rows. Trees of one forest share its draws, so they learn one after the other; splits and drift,
which are rare, are told tree by tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from streamtrial.operators.dice import Dice, _totals
from streamtrial.operators.drift import Adwin
from streamtrial.operators.forest import ForestRegressor, Tree, _Leaf, cuts
from streamtrial.operators.plain import steps
from streamtrial.operators.trees import bound

#: From so many forests on a step of numpy costs less than the forests one by one.
SIDE_BY_SIDE = 64
_GOLD, _ONE, _TWO = (np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def randoms(state: np.ndarray) -> np.ndarray:
    """The next draw of each of several dice, whose states move on."""
    state += _GOLD
    z = (state ^ state >> np.uint64(30)) * _ONE
    z = (z ^ z >> np.uint64(27)) * _TWO
    return ((z ^ z >> np.uint64(31)) >> np.uint64(11)) / float(1 << 53)


class Grove:
    """Forests (model, before, after, y, then) of one width and rate; ``then`` is filled with what a forest says to each row of ``after`` once it is learned. The longest come first."""

    INTS, FLOATS = ("feature", "left", "right", "depth", "held", "start"), ("threshold", "n", "mean", "b", "bad_mean", "bad_model")

    def __init__(self, jobs: list[tuple]):
        self.forests, self.lengths = [j[0] for j in jobs], np.array([len(j[3]) for j in jobs])
        width, self.subset = self.forests[0].settings[0], self.forests[0].settings[2]
        self.width, self.size = width, 0
        models = [len(f.trees) for f in self.forests]
        self.first = np.concatenate([[0], np.cumsum(models)])
        self.forest = np.repeat(np.arange(len(models)), models)
        each = lambda get: np.array([get(f) for f in self.forests])
        self.grace, self.lr = each(lambda f: f.settings[3]), each(lambda f: f.settings[8])
        self.delta, self.tie = each(lambda f: f.settings[4]), each(lambda f: f.settings[5])
        self.deepest = each(lambda f: 1 << 30 if f.settings[6] is None else f.settings[6])
        self.kind = each(lambda f: ("mean", "model", "adaptive").index(f.settings[7]))
        self.state = np.array([f.dice.state for f in self.forests], dtype=np.uint64)
        self.totals = np.array(_totals(self.forests[0].rate))
        for name in self.INTS:
            setattr(self, name, np.zeros(1024, dtype=np.int64))
        for name in self.FLOATS:
            setattr(self, name, np.zeros(1024))
        self.features, self.w = np.zeros((1024, self.subset), dtype=np.int64), np.zeros((width, 1024))
        self.rows, self.used = np.zeros(1 << 16, dtype=np.int64), 0
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        x, y, known = [j[2] for j in jobs], [np.array(j[3], dtype=float) for j in jobs], int(self.starts[-1])
        self.root, self.other, self.carried = [], [], (known, [], [])
        self.splits = {}
        for i, f in enumerate(self.forests):
            self.root += [self._taken(t, i) for t in f.trees]
            self.other += [-1 if t is None else self._taken(t, i) for t in f.behind]
        self.root, self.other = np.array(self.root), np.array(self.other)
        self.x = np.concatenate([*x, np.array(self.carried[1], dtype=float).reshape(-1, width)]).T.copy()
        self.y = np.concatenate([*y, self.carried[2]])
        self.before = self.x if all(j[1] is j[2] for j in jobs) else np.concatenate([j[1] for j in jobs]).T.copy()
        self.then = [j[4] for j in jobs]
        self.asked = [t is not None for t in self.then]

    # --- nodes -------------------------------------------------------------------------------------------

    def _made(self, n: int) -> np.ndarray:
        """Places of new nodes."""
        at, self.size = np.arange(self.size, self.size + n), self.size + n
        while self.size > len(self.feature):
            for name in (*self.INTS, *self.FLOATS, "features"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
            self.w = np.hstack([self.w, np.zeros_like(self.w)])
        return at

    def _room(self, n: int) -> int:
        """Where the rows of new leaves begin."""
        start, self.used = self.used, self.used + n
        while self.used > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        return start

    def _new(self, forest: int, depth: int, features: list[int], mean: float = 0.0, n: float = 0.0, leaf: bool = True) -> int:
        at = int(self._made(1)[0])
        self.feature[at], self.depth[at], self.features[at], self.mean[at], self.b[at], self.n[at] = -1, depth, features, mean, mean, n
        self.start[at] = self._room(int(self.grace[forest])) if leaf else 0
        return at

    def _taken(self, tree: Tree, forest: int) -> int:
        """A tree's nodes as places of the arrays; the root's."""
        known, xs, ys = self.carried
        waiting, top = [(tree.root, -1, "")], self.size
        while waiting:
            node, parent, side = waiting.pop()
            at = self._new(forest, node.depth, node.features, node.mean, node.n, node.feature is None)
            self.b[at], self.bad_mean[at], self.bad_model[at], self.w[:, at] = node.b, node.bad_mean, node.bad_model, node.w
            if side:
                getattr(self, side)[parent] = at
            if node.feature is not None:
                self.feature[at], self.threshold[at] = node.feature, node.threshold
                waiting += [(node.left, at, "left"), (node.right, at, "right")]
            elif node.y:
                self.held[at] = len(node.y)
                self.rows[self.start[at] : self.start[at] + len(node.y)] = known + len(ys) + np.arange(len(node.y))
                xs += node.x
                ys += node.y
        self.splits[top] = tree.splits
        return top

    def _given(self) -> None:
        """The nodes as trees of the forests again."""
        n, lists = self.size, {k: getattr(self, k)[: self.size].tolist() for k in (*self.INTS, *self.FLOATS, "features")}
        w = self.w[:, :n].T.tolist()
        leaf = np.flatnonzero((self.feature[:n] < 0) & (self.held[:n] > 0))
        size = self.held[leaf]
        ends = np.cumsum(size)
        at = self.rows[np.repeat(self.start[leaf] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        xs, ys = self.x[:, at].T.tolist(), self.y[at].tolist()
        held = {k: (a, b) for k, a, b in zip(leaf.tolist(), (ends - size).tolist(), ends.tolist())}

        def made(at: int) -> _Leaf:
            node = _Leaf(self.width, lists["features"][at], lists["depth"][at], lists["mean"][at], lists["n"][at])
            node.w, node.b, node.bad_mean, node.bad_model = w[at], lists["b"][at], lists["bad_mean"][at], lists["bad_model"][at]
            if at in held:
                a, b = held[at]
                node.x, node.y = xs[a:b], ys[a:b]
            return node

        def tree(f: ForestRegressor, top: int) -> Tree:
            out = Tree.__new__(Tree)
            out.width, out.dice, out.count, out.grace, out.delta, out.tie, out.depth, out.leaf, out.lr = f.settings
            out.root, out.splits = made(top), self.splits[top]
            waiting = [(top, out.root)]
            while waiting:
                at, node = waiting.pop()
                if lists["feature"][at] >= 0:
                    node.feature, node.threshold = lists["feature"][at], lists["threshold"][at]
                    node.left, node.right = made(lists["left"][at]), made(lists["right"][at])
                    waiting += [(lists["left"][at], node.left), (lists["right"][at], node.right)]
            return out

        for i, f in enumerate(self.forests):
            f.dice.state = int(self.state[i])
            for m, t in enumerate(range(self.first[i], self.first[i + 1])):
                f.trees[m] = tree(f, int(self.root[t]))
                f.behind[m] = tree(f, int(self.other[t])) if self.other[t] >= 0 else None

    def _subset(self, forest: int) -> list[int]:
        dice = Dice()
        dice.state = int(self.state[forest])
        order = sorted(range(self.width), key=lambda _: dice.random())
        self.state[forest] = dice.state
        return sorted(order[: self.subset])

    def _tree(self, forest: int) -> int:
        out = self._new(forest, 0, self._subset(forest))
        self.splits[out] = 0
        return out

    # --- rows --------------------------------------------------------------------------------------------

    def _at(self, top: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The leaf of a row (a column of ``x``) in each of the trees."""
        node = top.copy()
        live = np.flatnonzero(self.feature[node] >= 0)
        while len(live):
            own = node[live]
            own = np.where(x[self.feature[own], live] <= self.threshold[own], self.left[own], self.right[own])
            node[live] = own
            live = live[self.feature[own] >= 0]
        return node

    def _said(self, node: np.ndarray, forest: np.ndarray, x: np.ndarray) -> np.ndarray:
        kind, w = self.kind[forest], self.w[:, node]
        z = x[0] * w[0]
        for f in range(1, self.width):
            z += x[f] * w[f]
        z += self.b[node]
        plain = (kind == 0) | (self.n[node] == 0) | ((kind == 2) & (self.bad_mean[node] <= self.bad_model[node]))
        return np.where(plain, self.mean[node], z)

    def _together(self, said: np.ndarray, active: int) -> list[float]:
        """What the first forests say by what their trees say."""
        out = np.empty(active)
        for models, some in self.alike:
            some = some[: np.searchsorted(some, active)]
            own = said[self.first[some][:, None] + np.arange(models)]
            low, high = (models - 1) // 2, models // 2
            part = np.sort(own, axis=1)
            out[some] = (part[:, low] + part[:, high]) / 2
            mean = np.flatnonzero(self.mean_of[some] | np.isnan(own).any(1))
            if len(mean):
                out[some[mean]] = [sum(v) / len(v) for v in own[mean].tolist()]
        return out.tolist()

    def _learned(self, node: np.ndarray, forest: np.ndarray, x: np.ndarray, y: np.ndarray, row: np.ndarray, times: np.ndarray) -> None:
        """Each node's row so many times, at most as often as its leaf has room."""
        ends = np.cumsum(times)
        place = np.repeat(self.start[node] + self.held[node] - (ends - times), times) + np.arange(ends[-1])
        self.rows[place] = np.repeat(row, times)
        self.held[node] += times
        kind, order = self.kind[forest], np.argsort(-times, kind="stable")
        for model in (True, False) if not kind.all() else (True,):
            own = order[(kind[order] > 0) == model]
            if len(own):
                (self._modelled if model else self._averaged)(node[own], self.lr[forest[own]], x[:, own], y[own], times[own])

    def _averaged(self, node: np.ndarray, _, x: np.ndarray, y: np.ndarray, times: np.ndarray) -> None:
        """Leaves that predict means; those that learn most often come first."""
        n, mean = self.n[node], self.mean[node]
        for k in np.searchsorted(-times, -np.arange(times[0]), side="left").tolist():  # how many learn once more
            n[:k] += 1
            mean[:k] += (y[:k] - mean[:k]) / n[:k]
        self.n[node], self.mean[node] = n, mean

    def _modelled(self, node: np.ndarray, lr: np.ndarray, x: np.ndarray, y: np.ndarray, times: np.ndarray) -> None:
        """Leaves with a linear model, whose bias is a weight of a feature that is 1 (its step has no other clip than the error's)."""
        most, width = _Leaf.CLIP, self.width
        x, w = np.vstack([x, np.ones(len(node))]), np.vstack([self.w[:, node], self.b[node]])
        n, mean, bad, d = self.n[node], self.mean[node], np.stack([self.bad_mean[node], self.bad_model[node]]), np.empty((2, len(node)))
        z, step = np.empty(len(node)), np.empty(w.shape)
        last = -1
        for k in np.searchsorted(-times, -np.arange(times[0]), side="left").tolist():
            if k != last:
                u, v, own, c, m, e, s, g, t, rate, last = x[:, :k], w[:, :k], y[:k], n[:k], mean[:k], bad[:, :k], z[:k], step[:, :k], d[:, :k], lr[:k], k
                (d_mean, error), rows = t, list(g)
            np.multiply(u, v, out=g)
            np.add(rows[0], rows[1], out=s)
            for f in range(2, width + 1):
                np.add(s, rows[f], out=s)
            np.subtract(own, m, out=d_mean)
            np.subtract(own, s, out=error)
            e *= 0.95
            e += np.abs(t)
            c += 1
            d_mean /= c
            m += d_mean
            np.fmin(np.fmax(error, -most, out=error), most, out=error)  # NaN goes to the lower end, as in Python
            np.multiply(error, u, out=g)
            np.minimum(np.maximum(g, -most, out=g), most, out=g)
            g *= rate
            v += g
        self.n[node], self.mean[node], self.w[:, node], self.b[node], self.bad_mean[node], self.bad_model[node] = n, mean, w[:-1], w[-1], *bad

    def _learn(self, top: np.ndarray, node: np.ndarray, forest: np.ndarray, x: np.ndarray, y: np.ndarray, row: np.ndarray, times: np.ndarray) -> None:
        """Trees learn a row each, so many times; ``node`` is its leaf at first."""
        at = np.flatnonzero(times > 0)
        while len(at):
            own, f = node[at], forest[at]
            now = np.minimum(times[at], np.maximum(self.grace[f] - self.held[own], 1))
            self._learned(own, f, x[:, at], y[at], row[at], now)
            times = times.copy()
            times[at] -= now
            full = self.held[own] >= self.grace[f]
            if full.any():
                self._tried(own[full], f[full], top[at[full]])
            at = at[times[at] > 0]
            node = node.copy()
            node[at] = self._at(top[at], x[:, at])

    def _tried(self, node: np.ndarray, forest: np.ndarray, top: np.ndarray) -> None:
        """Leaves that had enough rows split, or forget them."""
        some = np.flatnonzero(self.depth[node] < self.deepest[forest])
        for grace in np.unique(self.grace[forest[some]]).tolist():
            at = some[self.grace[forest[some]] == grace]
            own, f = node[at], forest[at]
            rows = self.rows[self.start[own][:, None] + np.arange(grace)]
            y = self.y[rows]
            x = self.x[self.features[own].T[:, :, None], rows[None]].transpose(1, 0, 2)  # leaf, feature, row
            if grace < 2:
                continue
            around = (y - y.mean(1)[:, None])[:, None, :]
            gain, where = cuts(x.reshape(-1, grace), np.broadcast_to(around, x.shape).reshape(-1, grace))
            gain, where = gain.reshape(len(at), -1), where.reshape(len(at), -1)
            order = np.argsort(-gain, axis=1, kind="stable")
            lines = np.arange(len(at))
            best = order[:, 0]
            most = gain[lines, best]
            second = gain[lines, order[:, 1]] if gain.shape[1] > 1 else np.zeros(len(at))
            epsilon = np.array([bound(1.0, d, grace) for d in self.delta[f].tolist()])
            with np.errstate(all="ignore"):
                splits = (most > 0) & ((second / most < 1 - epsilon) | (epsilon < self.tie[f]))
            flat = y.min(1) == y.max(1)
            for i in np.flatnonzero(splits & (y.min(1) == y.max(1))).tolist():
                splits[i] = y[i].std() > 0
            if splits.any():
                done, at = np.flatnonzero(splits), at[splits]
                self._split(node[at], forest[at], self.features[node[at], best[done]], where[done, best[done]], x[done, best[done]], y[done])
                for tree in top[at].tolist():
                    self.splits[tree] += 1
        self.held[node] = 0

    def _split(self, node: np.ndarray, forest: np.ndarray, feature: np.ndarray, threshold: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        """Leaves of different forests split; the left child has the place of the rows."""
        below, k = x <= threshold[:, None], len(node)
        state = self.state[forest]
        draws = [randoms(state) for _ in range(2 * self.width)]
        self.state[forest] = state
        child = self._made(2 * k).reshape(2, k)
        grace = self.grace[forest]
        for side, own, at, drawn in (("left", below, child[0], draws[: self.width]), ("right", ~below, child[1], draws[self.width :])):
            rows = own.sum(1)
            mean = [float(np.add.reduce(v[o])) / n for v, o, n in zip(y, own, rows.tolist())]  # as numpy's mean
            self.feature[at], self.depth[at], self.n[at], self.mean[at], self.b[at] = -1, self.depth[node] + 1, rows, mean, mean
            self.features[at] = np.sort(np.argsort(np.stack(drawn, 1), axis=1, kind="stable")[:, : self.subset], axis=1)
            model = self.kind[forest] > 0
            self.w[:, at[model]], self.b[at[model]] = self.w[:, node[model]], self.b[node[model]]
            getattr(self, side)[node] = at
        self.start[child[0]], self.start[child[1]] = self.start[node], self.used + np.cumsum(grace) - grace
        self._room(int(grace.sum()))
        self.feature[node], self.threshold[node] = feature, threshold

    def run(self) -> list[list[float]]:
        """What each forest says to its rows before it learns them; the longest streams first, as ``jobs`` are."""
        self.models = np.diff(self.first)
        self.mean_of = np.array([f.combine == "mean" for f in self.forests])
        self.alike = [(int(m), np.flatnonzero(self.models == m)) for m in np.unique(self.models)]
        self.told = [list(pair) for f in self.forests for pair in f.told]
        self.clock = self.told[0][0].clock
        self.until = np.array([[a.clock - a.rows % a.clock for a in pair] for pair in self.told])  # rows to the next test of each detector
        self.since = np.zeros(self.until.shape, dtype=int)  # its first value in ``errors``
        self.errors = np.zeros((len(self.told), int(self.lengths[0])))
        out = [[] for _ in self.forests]
        with np.errstate(all="ignore"):
            for t in range(int(self.lengths[0])):
                self._row(t, out)
        for at, pair in enumerate(self.told):
            for j, a in enumerate(pair):
                self._handed(at, j, int(self.lengths[self.forest[at]]))
        for i, f in enumerate(self.forests):
            f.told = self.told[self.first[i] : self.first[i + 1]]
        self._given()
        return out

    def _handed(self, tree: int, j: int, end: int) -> Adwin:
        """A detector with the errors before row ``end``."""
        a = self.told[tree][j]
        values = self.errors[tree, self.since[tree, j] : end].tolist()
        a.rows += len(values)
        a.new += [(v, 0.0) for v in values]
        self.since[tree, j] = end
        return a

    def _row(self, t: int, out: list[list[float]]) -> None:
        active = int(np.searchsorted(-self.lengths, -t, side="left"))
        n = int(self.first[active])
        forest = self.forest[:n]
        row = self.starts[forest] + t
        x, y = self.x[:, row], self.y[row]
        node = self._at(self.root[:n], x)
        own = said = self._said(node, forest, x)
        if self.before is not self.x:
            x_before = self.before[:, row]
            said = self._said(self._at(self.root[:n], x_before), forest, x_before)
        for o, v in zip(out, self._together(said, active)):
            o.append(v)
        self.errors[:n, t] = np.abs(y - own)
        second = np.zeros(n, dtype=np.int64)
        behind = np.flatnonzero(self.other[:n] >= 0)
        second[behind] = self._at(self.other[behind], x[:, behind])
        for m in range(int(self.models[:active].max())):
            some = np.flatnonzero(self.models[:active] > m)
            state = self.state[some]
            times = np.searchsorted(self.totals, randoms(state), side="right")
            self.state[some] = state
            self._trees(self.first[some] + m, forest, node, second, x, y, row, times, t)
        if any(self.asked[:active]):
            for o, v in zip(self.then, self._together(self._said(self._at(self.root[:n], x), forest, x), active)):
                if o is not None:
                    o.append(v)

    def _trees(self, at: np.ndarray, forest: np.ndarray, node: np.ndarray, second: np.ndarray, x: np.ndarray, y: np.ndarray, row: np.ndarray, times: np.ndarray, t: int) -> None:
        """One tree of each forest, and the one behind it, learn a row; then drift is told. Where both will try to split, the one that is full first draws first."""
        grace, has = self.grace[forest[at]], self.other[at] >= 0
        room, room_behind = grace - self.held[node[at]], grace - self.held[second[at]]
        both = has & (times >= room) & (times >= room_behind)
        later = both & (room > room_behind)  # the tree, behind the one in the background
        turns = both & (times >= grace)
        first, last = at[~later & ~turns], at[has & (~both | later) & ~turns]
        by = np.zeros(len(forest), dtype=int)
        by[at] = times

        def learn(trees: np.ndarray, others: np.ndarray, times: np.ndarray) -> None:
            own = np.concatenate([trees, others])
            self._learn(np.concatenate([self.root[trees], self.other[others]]), np.concatenate([node[trees], second[others]]), forest[own], x[:, own], y[own], row[own], times[own])

        learn(first, last, by)
        if both.any():
            learn(at[later & ~turns], at[both & ~later & ~turns], by)
            for i in at[turns].tolist():
                one, none, once = np.array([i]), np.array([], dtype=int), np.ones(len(forest), dtype=int)
                for _ in range(int(by[i])):
                    node[i], second[i] = self._at(self.root[one], x[:, one])[0], self._at(self.other[one], x[:, one])[0]
                    learn(one, none, once)
                    learn(none, one, once)
        self.until[at] -= 1
        due = self.until[at] == 0
        for i, ticks in zip(at[due.any(1)].tolist(), due[due.any(1)].tolist()):
            warned, drifted = (tick and self._handed(i, j, t + 1)._cut() for j, tick in enumerate(ticks))
            self.until[i, ticks] = self.clock
            f = self.forests[forest[i]]
            if drifted:
                self.root[i], self.other[i] = self.other[i] if self.other[i] >= 0 else self._tree(int(forest[i])), -1
                self.told[i] = [Adwin(d) for d in f.deltas]
                self.until[i], self.since[i] = self.clock, t + 1
                f.replaced += 1
            elif warned:
                self.other[i] = self._tree(int(forest[i]))
                self.told[i][0] = Adwin(f.deltas[0])
                self.until[i, 0], self.since[i, 0] = self.clock, t + 1


def forests(jobs: list[tuple]) -> list[list[float]]:
    """``steps`` of many forests (model, before, after, y, then), with rows as arrays; in the order of the jobs."""
    kinds: dict[tuple, list[int]] = {}
    for i, (f, *_) in enumerate(jobs):
        kinds.setdefault((f.settings[0], f.rate, f.settings[2]), []).append(i)
    out: list = [None] * len(jobs)
    for at in kinds.values():
        order = sorted((i for i in at if len(jobs[i][3])), key=lambda i: -len(jobs[i][3]))
        for i, said in zip(order, Grove([jobs[i] for i in order]).run() if order else []):
            out[i] = said
    return [[] if o is None else o for o in out]


def together(runs: list[Iterator]) -> list[list]:
    """The ends of several ``going`` (see ``automl``), each over a stream: forests that are asked for at the same time go side by side, other learners one by one."""
    out: list = [None] * len(runs)
    asked: dict[int, list] = {}

    def go(i: int, told: list | None) -> None:
        try:
            asked[i] = runs[i].send(told)
        except StopIteration as end:
            out[i] = end.value
            asked.pop(i, None)

    for i in range(len(runs)):
        go(i, None)
    while asked:
        places = [(i, j) for i, jobs in asked.items() for j, (model, *_) in enumerate(jobs) if type(model) is ForestRegressor]
        places = places if len(places) >= SIDE_BY_SIDE else []
        known = dict(zip(places, forests([(*asked[i][j][:4], asked[i][j][6]) for i, j in places])))
        for i, jobs in list(asked.items()):
            told, lists = [], {}
            for j, (model, before, after, *more) in enumerate(jobs):
                if (i, j) not in known:
                    known[i, j] = steps(model, *(lists.setdefault(id(v), (v, v.tolist()))[1] for v in (before, after)), *more)
                told.append(known[i, j])
            go(i, told)
    return out
