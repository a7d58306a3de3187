"""A character-level bidirectional LSTM with a CRF on top, in numpy: training, batch scoring and decoding."""

from __future__ import annotations

import numpy as np

#: Numbers of characters: 0 pads, 1 is any other letter, 2 any other character, then printable ASCII and line ends.
PAD, LETTER, OTHER = 0, 1, 2
CHARS = {**{chr(c): c - 29 for c in range(32, 127)}, "\n": 98, "\t": 99}
SIZE = 100
_ascii = np.array([CHARS.get(chr(c), OTHER) for c in range(128)], np.int16)


def encode(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where(c < 128, _ascii[np.minimum(c, 127)], OTHER).astype(np.int16)
    for i in np.flatnonzero(c >= 128).tolist():
        if text[i].isalpha():
            out[i] = LETTER
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class CharTagger:
    """tags[0] is outside; the others come as B-kind, I-kind."""

    def __init__(self, kinds: list[str], width: int = 10, hidden: int = 16, seed: int = 7):
        self.kinds, self.tags = kinds, ["O"] + [f"{p}-{k}" for k in kinds for p in "BI"]
        r, n = np.random.default_rng(seed), len(self.tags)
        self.hidden = hidden
        self.p = {"emb": r.normal(0, 0.3, (SIZE, width)), "out": r.normal(0, 0.2, (2 * hidden, n)), "out_b": np.zeros(n), "trans": np.zeros((n, n)), "start": np.zeros(n)}
        for d in "fb":
            self.p |= {f"w{d}": r.normal(0, 0.3, (width, 4 * hidden)), f"u{d}": r.normal(0, 0.2, (hidden, 4 * hidden)), f"b{d}": np.r_[np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]}
        # an inside tag follows only a tag of its own kind
        self.forbidden = np.zeros((n, n))
        for j in range(2, n, 2):
            self.forbidden[:, j] = -1e4
            self.forbidden[[j - 1, j], j] = 0
        self.forbidden_start = np.where(np.isin(np.arange(n), np.arange(2, n, 2)), -1e4, 0.0)

    def _lstm(self, x: np.ndarray, d: str, keep: bool):
        n, t, _ = x.shape
        h, c, k = np.zeros((n, self.hidden)), np.zeros((n, self.hidden)), self.hidden
        z, u = x @ self.p[f"w{d}"] + self.p[f"b{d}"], self.p[f"u{d}"]
        out, saved = np.empty((n, t, k)), []
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            a = z[:, s] + h @ u
            gates, g = _sigmoid(a[:, : 3 * k]), np.tanh(a[:, 3 * k :])
            i, f, o = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :]
            new = f * c + i * g
            tc = np.tanh(new)
            if keep:
                saved.append((s, i, f, o, g, c, tc, h))
            c, h = new, o * tc
            out[:, s] = h
        return out, saved

    def emissions(self, x: np.ndarray, keep: bool = False):
        e = self.p["emb"][x]
        (hf, sf), (hb, sb) = self._lstm(e, "f", keep), self._lstm(e, "b", keep)
        h = np.concatenate([hf, hb], 2)
        y = h @ self.p["out"] + self.p["out_b"]
        return (y, (e, h, sf, sb)) if keep else y

    def _lstm_back(self, e, dh, saved, d, grads):
        k, u, w = self.hidden, self.p[f"u{d}"], self.p[f"w{d}"]
        de, dn, dc = np.zeros_like(e), np.zeros((len(e), k)), np.zeros((len(e), k))
        for s, i, f, o, g, c, tc, h in reversed(saved):
            dht = dh[:, s] + dn
            dct = dc + dht * o * (1 - tc * tc)
            da = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), dht * tc * o * (1 - o), dct * i * (1 - g * g)], 1)
            dc, dn = dct * f, da @ u.T
            grads[f"u{d}"] += h.T @ da
            grads[f"w{d}"] += e[:, s].T @ da
            grads[f"b{d}"] += da.sum(0)
            de[:, s] = da @ w.T
        return de

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tag sequences, and gradients."""
        em, (e, h, sf, sb) = self.emissions(x, keep=True)
        n, t, m = em.shape
        trans, start = self.p["trans"] + self.forbidden, self.p["start"] + self.forbidden_start
        alpha, beta = np.empty((n, t, m)), np.zeros((n, t, m))

        def lse(v, axis):
            top = v.max(axis, keepdims=True)
            return np.squeeze(top, axis) + np.log(np.exp(v - top).sum(axis))

        alpha[:, 0] = start + em[:, 0]
        for s in range(1, t):
            alpha[:, s] = lse(alpha[:, s - 1, :, None] + trans, 1) + em[:, s]
        for s in range(t - 2, -1, -1):
            beta[:, s] = lse(trans + (em[:, s + 1] + beta[:, s + 1])[:, None, :], 2)
        z = lse(alpha[:, -1], 1)
        rows = np.arange(n)
        score = start[y[:, 0]] + em[rows[:, None], np.arange(t), y].sum(1) + trans[y[:, :-1], y[:, 1:]].sum(1)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        d_em = np.exp(alpha + beta - z[:, None, None])
        g["start"] = d_em[:, 0].sum(0) / n
        pair = np.exp(alpha[:, :-1, :, None] + trans + (em[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
        g["trans"] = pair.sum((0, 1)) / n
        np.add.at(g["trans"], (y[:, :-1].ravel(), y[:, 1:].ravel()), -1 / n)
        np.add.at(g["start"], y[:, 0], -1 / n)
        d_em[rows[:, None], np.arange(t), y] -= 1
        d_em /= n
        g["out"], g["out_b"] = np.einsum("nth,ntm->hm", h, d_em), d_em.sum((0, 1))
        dh = d_em @ self.p["out"].T
        de = self._lstm_back(e, dh[..., : self.hidden], sf, "f", g) + self._lstm_back(e, dh[..., self.hidden :], sb, "b", g)
        np.add.at(g["emb"], x, de)
        return float((z - score).mean()), g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 0.02, seed: int = 11) -> float:
        """Adam over shuffled batches; returns the last epoch's mean loss."""
        r, m, v, step, mean = np.random.default_rng(seed), {}, {}, 0, 0.0
        for epoch in range(epochs):
            losses = []
            for part in np.array_split(r.permutation(len(x)), max(1, len(x) // batch)):
                loss, g = self.loss(x[part], y[part])
                losses.append(loss)
                step += 1
                for k, d in g.items():
                    d = np.clip(d, -1, 1)
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * d
                    v[k] = 0.99 * v.get(k, 0) + 0.01 * d * d
                    self.p[k] -= rate / (1 + epoch / 4) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
            mean = float(np.mean(losses))
        return mean

    def viterbi(self, em: np.ndarray) -> np.ndarray:
        """The best tag sequence of one text's emissions (t, tags)."""
        trans = self.p["trans"] + self.forbidden
        best, back = self.p["start"] + self.forbidden_start + em[0], np.empty(em.shape, np.int8)
        for s in range(1, len(em)):
            v = best[:, None] + trans
            back[s] = v.argmax(0)
            best = v[back[s], np.arange(em.shape[1])] + em[s]
        out = np.empty(len(em), np.int8)
        out[-1] = best.argmax()
        for s in range(len(em) - 1, 0, -1):
            out[s - 1] = back[s, out[s]]
        return out

    def spans(self, tags: np.ndarray) -> list[tuple[str, int, int]]:
        """(kind, start, end) of each run that a B tag begins."""
        out = []
        for s in np.flatnonzero((tags % 2 == 1)).tolist():
            e = s + 1
            while e < len(tags) and tags[e] == tags[s] + 1:
                e += 1
            out.append((self.kinds[tags[s] // 2], s, e))
        return out
