"""A causal self-attention model over subword ids, trained and run in numpy.

The text's subwords are cut into blocks; a window is a block and the one before, and only the
window's own block is scored, so windows overlap and each token is scored once, with at least a
block of context where the text has one. All windows of a chunk run as one batch of masked
attention.

Output in three steps. The group of the next id's class, then the class in it, come from the attention
layer, each on top of a direct path from the id before, whose tables are set from the pair counts of
all training texts and not trained. Each choice has weights of its own, so a token meets only its own
group's classes, and its logits are as many as groups and a group's classes, not as all classes.
Frequent ids are a class of their own, the others share classes by frequency; within a class an
id has its share of the class's count after the id before, smoothed by its share anywhere. So the
probabilities of all ids add up to one. With one group its choice is left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Shape:
    ids: int  # size of the tokenizer's vocabulary; the end of the text is one id more
    dim: int = 24
    block: int = 8
    classes: int = 128
    inputs: int = 2048  # ids with an input vector and pair counts of their own
    groups: int = 1  # of about as many classes each; the model tells first the group, then the class in it
    #: Smoothing counts of the class after an id, and of an id within a class after an id.
    class_smooth: float = 5.0
    id_smooth: float = 2.0


class Numbering:
    """Ids by frequency: their classes, input rows and columns of pair counts."""

    def __init__(self, shape: Shape, counts: np.ndarray):
        """counts: of each id in the training texts, the end included."""
        self.shape = shape
        order = np.argsort(-counts, kind="stable")
        self.own = own = shape.classes * 3 // 4
        klass = np.zeros(shape.ids + 1, np.int64)
        klass[order[:own]] = np.arange(min(own, len(order)))
        # Other ids: classes of about equal count.
        rest = order[own:]
        mass = np.cumsum(counts[rest] + 0.1)
        klass[rest] = own + np.minimum(shape.classes - own - 1, mass / mass[-1] * (shape.classes - own) if len(rest) else mass).astype(np.int64)
        self.klass = klass
        # Frequent ids, then one for each class of the others; inputs have the beginning of a text besides.
        self.row = shape.inputs + klass
        self.row[order[: shape.inputs]] = np.arange(min(shape.inputs, len(order)))
        self.columns = self.begin = shape.inputs + shape.classes
        self.klass_of_column = np.concatenate([np.zeros(shape.inputs, np.int64), np.arange(shape.classes)])
        self.klass_of_column[self.row] = klass
        self.first_of_group = np.arange(shape.groups + 1) * shape.classes // shape.groups
        self.group = np.repeat(np.arange(shape.groups), np.diff(self.first_of_group)).astype(np.uint8 if shape.groups <= 256 else np.int64)

    def before(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The input row of each token of ragged texts: that of the id before it."""
        out = np.empty(len(ids), np.int64)
        out[1:] = self.row[ids[:-1]]
        out[(np.cumsum(sizes) - sizes)[sizes > 0]] = self.begin
        return out

    def pairs(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """row * columns + column of every token with what is before it."""
        return self.before(ids, sizes) * self.columns + self.row[ids]


def blocks_of(sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each token of ragged texts stands in the padded blocks, and which blocks begin a text."""
    n = -(-sizes // block)
    first = np.cumsum(n) - n
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first * block, sizes)
    opens = np.zeros(int(n.sum()), bool)
    opens[first[n > 0]] = True
    return at, opens


def _log_share(z: np.ndarray, u: np.ndarray, alone: np.ndarray, rows: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Natural log of the probability of `own` among the columns of u; alone: what each input row adds to the logits."""
    logits = z @ u
    logits += np.take(alone, rows, axis=0)
    top = logits.reshape(-1)[np.arange(0, logits.size, logits.shape[1]) + own]
    np.exp(logits, out=logits)
    return top - np.log(logits @ np.ones(logits.shape[1], logits.dtype))


class Attention:
    def __init__(self, numbering: Numbering, counts: np.ndarray, pair: np.ndarray, pair_n: np.ndarray, seed: int = 3):
        """counts: of ids; pair, pair_n: the distinct pairs() of the training texts, sorted, and their counts."""
        self.numbering, self.shape = numbering, numbering.shape
        shape, k, columns = self.shape, self.shape.classes, numbering.columns
        smoothed = counts + 0.1
        of_class = np.bincount(numbering.klass, smoothed, k)
        of_column = np.bincount(numbering.row, smoothed, columns)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.column_share = np.where(of_column > 0, of_column / of_class[numbering.klass_of_column], 0)
        self.of_id = np.where(numbering.klass < numbering.own, 0, np.log(smoothed / of_column[numbering.row]))
        self.of_column = None  # made where it is first used
        row, klass = pair // columns, numbering.klass_of_column[pair % columns]
        after = np.bincount(row * k + klass, pair_n, (columns + 1) * k).reshape(columns + 1, k)
        self.after_n = after.astype(np.float32)
        share = of_class / of_class.sum()
        smooth, first = shape.class_smooth, numbering.first_of_group
        before = after + smooth * share
        all_before = after.sum(1, keepdims=True) + smooth
        groups = np.add.reduceat(before, first[:-1], axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            # Of the groups, and of each group's classes in it; a group without ids has none, and nothing is in it.
            self.direct_group = np.log(groups / all_before).astype(np.float32)
            self.direct = [np.log(before[:, lo:hi] / groups[:, k : k + 1]).astype(np.float32) for k, (lo, hi) in enumerate(zip(first, first[1:]))]
        # Classes of one id need no counts within them.
        shared = klass >= numbering.own
        self.pair, self.pair_n = pair[shared], pair_n[shared]
        rng, d = np.random.default_rng(seed), shape.dim
        init = lambda scale, *s: (rng.standard_normal(s) * scale / np.sqrt(s[0] if s[0] == d else 1)).astype(np.float32)
        self.w = {"e": init(0.3, columns + 1, d), "q": init(0.3, d, d), "k": init(0.3, d, d), "v": init(0.3, d, d), "o": init(0.3, d, d), "u": init(0.03, d, k), "r": np.zeros(2 * shape.block, np.float32), "c": np.zeros(k, np.float32)}
        if shape.groups > 1:
            self.w |= {"gu": init(0.03, d, shape.groups), "gc": np.zeros(shape.groups, np.float32)}
        b = shape.block
        back = np.arange(b)[:, None] + b - np.arange(2 * b)[None, :]  # how far back each key of a window is
        self.back, self.seen = np.maximum(back, 0), back >= 0
        self.cells = np.arange((columns + 1) * d).reshape(-1, d)  # the places of a row's vector in all of e

    def _attend(self, q: np.ndarray, keys: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """Weights of each window's keys, which stand in columns, for its own block's queries; opens: blocks without one before."""
        s = q @ keys
        s += np.where(self.seen, self.w["r"][self.back], np.float32(-30))
        s[opens, :, : self.shape.block] = -30
        np.exp(s, out=s)
        # Sums over so few columns take a fraction of the time as products.
        row = s.reshape(-1, s.shape[2])
        row *= (1 / (row @ np.ones(s.shape[2], s.dtype)))[:, None]
        return s

    def _windows(self, y: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Columns lo..hi of the rows of y, (blocks + 1) * block of them, as windows of two blocks; a view."""
        b, (down, right) = self.shape.block, y.strides
        return np.lib.stride_tricks.as_strided(y[:, lo:hi], (len(y) // b - 1, 2 * b, hi - lo), (b * down, down, right), writeable=False)

    def _upright(self, y: np.ndarray) -> np.ndarray:
        """As _windows, of all columns of the transpose y: each window is transposed too, which small products take without a copy."""
        b, (down, right) = self.shape.block, y.strides
        return np.lib.stride_tricks.as_strided(y, (y.shape[1] // b - 1, len(y), 2 * b), (b * right, down, right), writeable=False)

    def _by_key(self, s: np.ndarray) -> np.ndarray:
        """What s has for each block's queries and their window's keys, for each block's keys and the queries of it and of the next block."""
        b = self.shape.block
        out = np.zeros((len(s), b, 2 * b), s.dtype)
        out[:, :, :b] = s[:, :, b:].transpose(0, 2, 1)
        out[:-1, :, b:] = s[1:, :, :b].transpose(0, 2, 1)
        return out

    def _step(self, rows: np.ndarray, opens: np.ndarray, klass: np.ndarray, real: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss and gradients over the real positions."""
        w, d, b, n, scale = self.w, self.shape.dim, self.shape.block, len(rows), np.float32(self.shape.dim**-0.5)
        flat = lambda y: y.reshape(-1, y.shape[-1])
        # A block before the first, which no window sees, and one after the last make all windows views of one array.
        edge = np.full(b, self.numbering.begin)
        x = np.take(w["e"], np.concatenate([edge, rows.reshape(-1), edge]), axis=0)
        # Only the products of q and k, and of v and o, meet the tokens: x is its own key.
        qk, vo = w["q"] @ w["k"].T * scale, w["v"] @ w["o"]
        both = np.concatenate([qk, vo], axis=1)
        y = x @ both
        q, values = y[b:-b, :d].reshape(n, b, d), self._windows(y[:-b], d, 2 * d)
        a = self._attend(q, self._upright(np.ascontiguousarray(x[:-b].T)), opens)
        own = x[b:-b]
        # The last column, of ones, is the bias's.
        h = np.ones((n * b, d + 1), x.dtype)
        np.add(own, flat(a @ values), out=h[:, :d])
        loss, g, dz = self._output(h, rows.reshape(-1), klass.reshape(-1), real.reshape(-1))
        dh = dz[:-b]
        ds = dh.reshape(n, b, d) @ self._upright(np.ascontiguousarray(y[:-b, d:].T))
        ds *= a
        ds -= a * (flat(ds) @ np.ones(2 * b, x.dtype)).reshape(n, b, 1)
        g["r"] = np.bincount(self.back[self.seen], ds.sum(0)[self.seen], 2 * b).astype(np.float32)
        dy = np.empty((n * b, 2 * d), x.dtype)
        dq, dv = (dy[:, k * d : (k + 1) * d].reshape(n, b, d) for k in range(2))
        np.matmul(ds, self._windows(x[:-b], 0, d), out=dq)
        np.matmul(self._by_key(a), self._windows(dz, 0, d), out=dv)
        dqk, dvo = np.split(own.T @ dy, 2, axis=1)
        g |= {"q": dqk @ w["k"] * scale, "k": dqk.T @ w["q"] * scale, "v": dvo @ w["o"].T, "o": w["v"].T @ dvo}
        dx = dy @ both.T
        dx += dh
        dx += flat(self._by_key(ds) @ self._windows(y[b:], 0, d))
        g["e"] = np.zeros_like(w["e"])
        np.add.at(g["e"].reshape(-1), np.take(self.cells, rows.reshape(-1), axis=0).reshape(-1), dx.reshape(-1))
        return loss, g

    def _by_group(self, klass: np.ndarray) -> list[tuple[int, int, slice]]:
        """For each group that classes in order are of: its first class, the next group's and where its own stand."""
        ends = np.cumsum(np.bincount(self.numbering.group[klass], minlength=self.shape.groups)).tolist()
        first = self.numbering.first_of_group.tolist()
        return [(first[k], first[k + 1], slice(lo, hi)) for k, (lo, hi) in enumerate(zip([0, *ends], ends)) if lo < hi]

    def _output(self, h: np.ndarray, rows: np.ndarray, klass: np.ndarray, real: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Mean loss, gradients of the output weights and of h, a block of zeros after it. h: with a column of ones."""
        w, n, d, b = self.w, len(h), self.shape.dim, self.shape.block
        dh, chance, du = np.zeros((n + b, d), h.dtype), np.empty(n, h.dtype), np.empty((d + 1, self.shape.classes), h.dtype)
        weight = (real / max(1, int(real.sum()))).astype(h.dtype)
        if self.shape.groups == 1:
            du[:] = self._choice(h, w["u"], w["c"], self.direct[0], rows, klass, weight, chance, dh[:n])
            loss = -float((np.log(np.maximum(chance, 1e-12)) * weight).sum())
            return loss, {"u": du[:-1], "c": du[-1]}, dh
        group = self.numbering.group[klass]
        order = np.argsort(group, kind="stable")
        h, rows, klass, weight, group = np.take(h, order, axis=0), rows[order], klass[order], weight[order], group[order]
        ours, within = np.empty((n, d), h.dtype), np.empty((n, d), h.dtype)
        dg = self._choice(h, w["gu"], w["gc"], self.direct_group, rows, group, weight, chance, ours)
        loss = -float((np.log(np.maximum(chance, 1e-12)) * weight).sum())
        du[:] = 0
        for lo, hi, cut in self._by_group(klass):
            du[:, lo:hi] = self._choice(h[cut], w["u"][:, lo:hi], w["c"][lo:hi], self.direct[group[cut.start]], rows[cut], klass[cut] - lo, weight[cut], chance[cut], within[cut])
        loss -= float((np.log(np.maximum(chance, 1e-12)) * weight).sum())
        ours += within
        dh[order] = ours
        return loss, {"u": du[:-1], "c": du[-1], "gu": dg[:-1], "gc": dg[-1]}, dh

    def _choice(self, h: np.ndarray, u: np.ndarray, c: np.ndarray, direct: np.ndarray, rows: np.ndarray, own: np.ndarray, weight: np.ndarray, chance: np.ndarray, dh: np.ndarray, cells: int = 1 << 16) -> np.ndarray:
        """Gradients of u and, below it, of c of one choice among columns, about `cells` logits at a time; fills in the chance of `own` and the gradient of h."""
        part = max(1, cells // u.shape[1])
        uc, ut = np.concatenate([u, c[None]]), np.ascontiguousarray(u.T)
        du, ones = 0.0, np.ones(u.shape[1], u.dtype)
        for lo in range(0, len(h), part):
            cut = slice(lo, lo + part)
            # Log probabilities and a few units: no largest one need be taken off.
            p = h[cut] @ uc
            p += np.take(direct, rows[cut], axis=0)
            np.exp(p, out=p)
            total = p @ ones
            mine = np.arange(0, p.size, p.shape[1]) + own[cut]
            at = p.reshape(-1)[mine]
            np.divide(at, total, out=chance[cut])
            p.reshape(-1)[mine] = at - total
            share = (weight[cut] / total)[:, None]
            # What is narrower is divided by the totals: the logits, or what they are multiplied with and give.
            if p.shape[1] < 2 * h.shape[1]:
                p *= share
                du = du + h[cut].T @ p
                np.matmul(p, ut, out=dh[cut])
            else:
                du = du + (h[cut] * share).T @ p
                np.multiply(p @ ut, share, out=dh[cut])
        return du

    def _padded(self, before: np.ndarray, sizes: np.ndarray):
        """Places and input rows of ragged texts in blocks, and the blocks that begin a text."""
        at, opens = blocks_of(sizes, self.shape.block)
        rows = np.full(len(opens) * self.shape.block, self.numbering.begin)
        rows[at] = before
        return at, rows.reshape(-1, self.shape.block), opens

    def train(self, before: np.ndarray, ids: np.ndarray, sizes: np.ndarray, real: np.ndarray, least_steps: int, batch: int = 512, rate: float = 0.01) -> list[float]:
        """Adam over runs of `batch` blocks, all of them once, or again until there are `least_steps` steps.

        before: input rows of the tokens `ids` of ragged texts; real: tokens that count, the others are context.
        """
        at, rows, opens = self._padded(before, sizes)
        klass, counted = np.zeros(rows.size, np.int64), np.zeros(rows.size, bool)
        klass[at], counted[at] = self.numbering.klass[ids], real
        klass, counted = klass.reshape(rows.shape), counted.reshape(rows.shape)
        cuts = [slice(lo, lo + batch) for lo in range(0, len(rows), batch)]
        steps, losses = len(cuts) * max(1, -(-least_steps // max(1, len(cuts)))), []
        # All weights as one array, of which self.w has views.
        names = sorted(self.w)
        flat = np.concatenate([self.w[k].reshape(-1) for k in names])
        ends = np.cumsum([self.w[k].size for k in names])
        self.w = {k: y.reshape(self.w[k].shape) for k, y in zip(names, np.split(flat, ends[:-1]), strict=True)}
        m, s = np.zeros_like(flat), np.zeros_like(flat)
        for t in range(1, steps + 1):
            cut = cuts[(t - 1) % len(cuts)]
            first = opens[cut].copy()
            first[:1] = True
            loss, g = self._step(rows[cut], first, klass[cut], counted[cut])
            losses.append(loss)
            lr = rate * min(1, t / 20) * (1 - t / (steps + 1))
            now = np.concatenate([g[k].reshape(-1) for k in names]).astype(flat.dtype, copy=False)
            m += 0.1 * (now - m)
            now *= now
            s += 0.01 * (now - s)
            np.sqrt(s, out=now)
            now += 1e-8 * (1 - 0.99**t) ** 0.5
            np.divide(m, now, out=now)
            now *= lr * (1 - 0.99**t) ** 0.5 / (1 - 0.9**t)
            flat -= now
        return losses

    def score(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 probability of each text; ids: those of the texts with their ends, one after another."""
        sums, ends = np.concatenate([[0], np.cumsum(self.logs(ids, sizes))]), np.cumsum(sizes)
        return (sums[ends] - sums[ends - sizes]) / np.log(10)

    def logs(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Natural log probability of each id, given those before it in its text."""
        before = self.numbering.before(ids, sizes)
        at, rows, opens = self._padded(before, sizes)
        out, klass = np.zeros(rows.size, np.float32), np.zeros(rows.size, np.int64)
        klass[at] = self.numbering.klass[ids]
        b, d, w = self.shape.block, self.shape.dim, self.w
        # The weights do not change here, so what depends on an input row alone is looked up.
        y = w["e"] @ np.concatenate([w["q"] * np.float32(d**-0.5), w["k"], w["v"] @ w["o"]], axis=1)
        first = self.numbering.first_of_group
        of_class = [(w["u"][:, lo:hi], w["e"] @ w["u"][:, lo:hi] + w["c"][lo:hi] + direct) for lo, hi, direct in zip(first, first[1:], self.direct)]
        of_group = (w["gu"], w["e"] @ w["gu"] + w["gc"] + self.direct_group) if self.shape.groups > 1 else None
        led = np.concatenate([np.full((1, b), self.numbering.begin), rows])
        part = max(1, (8192 if of_group else 1024) // b)
        for lo in range(0, len(rows), part):
            # The block before comes along as context.
            here = led[lo : lo + part + 1].reshape(-1)
            of = np.take(y, here, axis=0)
            keys = self._upright(np.ascontiguousarray(of[:, d : 2 * d].T))
            a = self._attend(of[b:, :d].reshape(-1, b, d), keys, opens[lo : lo + part])
            z = (a @ self._windows(of, 2 * d, 3 * d)).reshape(-1, d)
            row, own = here[b:], klass[lo * b : (lo + part) * b]
            got = out[lo * b : (lo + part) * b]
            if of_group is None:
                got[:] = _log_share(z, *of_class[0], row, own)
                continue
            group = self.numbering.group[own]
            order = np.argsort(group, kind="stable")
            z, row, own, group = np.take(z, order, axis=0), row[order], own[order], group[order]
            sums = _log_share(z, *of_group, row, group)
            for first_class, _, cut in self._by_group(own):
                sums[cut] += _log_share(z[cut], *of_class[group[cut.start]], row[cut], own[cut] - first_class)
            got[order] = sums
        return out[at].astype(np.float64) + self._within(before, ids)

    def _within(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural log probability of each id among those of its class."""
        if self.of_column is None:
            self.of_column = self._column_logs()
        return self.of_column[before * self.numbering.columns + self.numbering.row[ids]] + self.of_id[ids]

    def _column_logs(self) -> np.ndarray:
        """For all pairs() the natural log probability of the column among those of its class, in one flat array."""
        smooth, klass = self.shape.id_smooth, self.numbering.klass_of_column
        out = np.tile((smooth * self.column_share).astype(np.float32), (self.numbering.columns + 1, 1))
        out.reshape(-1)[self.pair] += self.pair_n
        out /= self.after_n[:, klass] + np.float32(smooth)
        with np.errstate(divide="ignore"):
            np.log(out, out=out)
        out[:, klass < self.numbering.own] = 0
        return out.reshape(-1)
