"""A character tagger in numpy: bidirectional LSTM with CRF transitions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from geonear.llm.codepoints import class_table

KINDS = ("email", "ip", "card", "phone")
#: Tags: outside, then begin and inside of each kind.
N_TAGS = 1 + 2 * len(KINDS)
PAD = 132  # symbol beyond the ends of a text
N_SYMBOLS = PAD + 1
WINDOW = 96
STEP = 48  # windows overlap by half


def symbols_of(codes: np.ndarray) -> np.ndarray:
    """ASCII as it is, other characters by class."""
    return np.where(codes < 128, codes, 128 + class_table()[codes]).astype(np.int64)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def _lse(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Tagger:
    """Weights: per direction an input table and a recurrent matrix; emissions; transitions."""

    table: list[np.ndarray]  # N_SYMBOLS x 4H: embedding, input weights and bias in one
    recur: list[np.ndarray]  # H x 4H
    emit: np.ndarray  # 2H x tags
    bias: np.ndarray
    trans: np.ndarray  # from x to

    @classmethod
    def fresh(cls, hidden: int, rng: np.random.Generator) -> Tagger:
        table = [rng.normal(0, 0.3, (N_SYMBOLS, 4 * hidden)) for _ in range(2)]
        for t in table:
            t[:, hidden:2 * hidden] += 1.0  # remember at first
        return cls(table, [rng.normal(0, 0.2, (hidden, 4 * hidden)) for _ in range(2)],
                   rng.normal(0, 0.2, (2 * hidden, N_TAGS)), np.zeros(N_TAGS), np.zeros((N_TAGS, N_TAGS)))

    def weights(self) -> list[np.ndarray]:
        return [*self.table, *self.recur, self.emit, self.bias, self.trans]

    def _lstm(self, d: int, x: np.ndarray, keep: bool):
        """States in time order of ``x`` (time x batch); what backpropagation needs, if kept."""
        table, recur = self.table[d], self.recur[d]
        size = recur.shape[0]
        h = c = np.zeros((x.shape[1], size), table.dtype)
        out, memory = np.empty((len(x), x.shape[1], size), table.dtype), []
        for t in range(len(x)) if d == 0 else range(len(x) - 1, -1, -1):
            z = table[x[t]] + h @ recur
            gate = _sigmoid(z[:, :3 * size])
            g = np.tanh(z[:, 3 * size:])
            i, f, o = gate[:, :size], gate[:, size:2 * size], gate[:, 2 * size:]
            before, c_before = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep:
                memory.append((t, before, c_before, i, f, o, g, tc))
        return out, memory

    def emissions(self, x: np.ndarray, keep: bool = False):
        runs = [self._lstm(d, x, keep) for d in range(2)]
        states = np.concatenate([r[0] for r in runs], axis=2)
        return states @ self.emit + self.bias, states, [r[1] for r in runs]

    def posteriors(self, e: np.ndarray):
        """Forward and backward sums, and the log of the partition function."""
        steps = len(e)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        alpha[0, :, 2::2] -= 1e4  # no text begins inside a span
        for t in range(1, steps):
            alpha[t] = e[t] + _lse(alpha[t - 1][:, :, None] + self.trans, 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = _lse(self.trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        return alpha, beta, _lse(alpha[-1], 1)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean negative log-likelihood of the tags ``y`` (time x batch), and its gradient."""
        e, states, memories = self.emissions(x, True)
        steps, n = x.shape
        alpha, beta, z = self.posteriors(e)
        grid = np.arange(n)
        gold = e[np.arange(steps)[:, None], grid, y].sum(axis=0) + self.trans[y[:-1], y[1:]].sum(axis=0)
        de = np.exp(alpha + beta - z[:, None])
        de[np.arange(steps)[:, None], grid, y] -= 1
        dtrans = np.zeros_like(self.trans)
        for t in range(1, steps):
            both = alpha[t - 1][:, :, None] + self.trans + (e[t] + beta[t])[:, None, :] - z[:, None, None]
            dtrans += np.exp(both).sum(axis=0)
        np.add.at(dtrans, (y[:-1].reshape(-1), y[1:].reshape(-1)), -1)
        de /= n
        dtrans /= n
        flat = states.reshape(-1, states.shape[2])
        demit, dbias = flat.T @ de.reshape(-1, N_TAGS), de.sum(axis=(0, 1))
        dstates = de @ self.emit.T
        size = self.recur[0].shape[0]
        dtable, drecur = [], []
        for d in range(2):
            own = dstates[:, :, d * size:(d + 1) * size]
            gt, gr = np.zeros_like(self.table[d]), np.zeros_like(self.recur[d])
            dh = dc = np.zeros((n, size))
            for t, before, c_before, i, f, o, g, tc in reversed(memories[d]):
                dh = dh + own[t]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * g * i * (1 - i), dc * c_before * f * (1 - f),
                                     dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                np.add.at(gt, x[t], dz)
                gr += before.T @ dz
                dh, dc = dz @ self.recur[d].T, dc * f
            dtable.append(gt)
            drecur.append(gr)
        return float((z - gold).mean()), [*dtable, *drecur, demit, dbias, dtrans]

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags by Viterbi (batch x time) and each tag's posterior. ``x`` is batch x time."""
        e, _, _ = self.emissions(np.ascontiguousarray(x.T))
        steps, n, _ = e.shape
        best, back = e[0].copy(), np.zeros((steps, n, N_TAGS), np.int8)
        best[:, 2::2] -= 1e4
        for t in range(1, steps):
            ways = best[:, :, None] + self.trans
            back[t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + e[t]
        tags = np.empty((steps, n), np.int64)
        tags[-1] = best.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = back[t][np.arange(n), tags[t]]
        alpha, beta, z = self.posteriors(e)
        at = np.arange(steps)[:, None], np.arange(n), tags
        return tags.T, np.exp(alpha[at] + beta[at] - z).T


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 12, batch: int = 32,
          rate: float = 0.02, seed: int = 3) -> Tagger:
    """Fit a tagger to windows ``x`` and their tags ``y`` (both rows x WINDOW)."""
    rng = np.random.default_rng(seed)
    tagger = Tagger.fresh(hidden, rng)
    first = [np.zeros_like(w) for w in tagger.weights()]
    second = [np.zeros_like(w) for w in tagger.weights()]
    step = 0
    total = epochs * -(-len(x) // batch)
    for _ in range(epochs if len(x) else 0):
        order = rng.permutation(len(x))
        for i in range(0, len(order), batch):
            rows = order[i:i + batch]
            _, grads = tagger.gradient(np.ascontiguousarray(x[rows].T), np.ascontiguousarray(y[rows].T))
            norm = np.sqrt(sum((g * g).sum() for g in grads))
            step += 1
            lr = rate * (1 - 0.9 * step / total)
            for w, g, a, b in zip(tagger.weights(), grads, first, second):
                g = g * min(1.0, 5.0 / max(norm, 1e-12))
                a *= 0.9
                a += 0.1 * g
                b *= 0.999
                b += 0.001 * g * g
                w -= lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return tagger


def single(tagger: Tagger) -> Tagger:
    """The same weights in single precision, for decoding."""
    f = np.float32
    return Tagger([w.astype(f) for w in tagger.table], [w.astype(f) for w in tagger.recur],
                  tagger.emit.astype(f), tagger.bias.astype(f), tagger.trans.astype(f))
