"""A character tagger in numpy: embeddings, a bidirectional LSTM and a linear-chain CRF, trained by Adam."""

from __future__ import annotations

import numpy as np

CHARS = {c: i + 3 for i, c in enumerate(map(chr, range(32, 127)))} | {"\n": 2}


def codes(text: str) -> list[int]:
    """1: any other letter, 0: padding and the rest."""
    return [CHARS.get(c) or (1 if c.isalpha() else 0) for c in text]


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class CharTagger:
    def __init__(self, tags: int, size: int = 16, hidden: int = 24, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        scale = lambda *s: rng.normal(0, s[0] ** -0.5, s)
        self.w = {"e": rng.normal(0, 0.5, (len(CHARS) + 3, size)), "o": scale(2 * hidden, tags), "c": np.zeros(tags), "t": np.zeros((tags, tags))}
        for d in "fb":
            self.w |= {f"x{d}": scale(size, 4 * hidden), f"h{d}": scale(hidden, 4 * hidden), f"b{d}": np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])}

    def run(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, batch, hidden) of one direction over x (time, batch, size); keep gets what backward needs."""
        n, k = self.hidden, range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        z_all = x @ self.w[f"x{d}"] + self.w[f"b{d}"]
        h, c = np.zeros((x.shape[1], n)), np.zeros((x.shape[1], n))
        out = np.zeros((len(x), x.shape[1], n))
        for t in k:
            z = z_all[t] + h @ self.w[f"h{d}"]
            s = sigmoid(z[:, : 3 * n])
            g = np.tanh(z[:, 3 * n :])
            i, f, o = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :]
            before, h_before = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep is not None:
                keep.append((t, i, f, o, g, before, h_before, tc))
        return out

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Scores (time, batch, tag) of ids (time, batch)."""
        x = self.w["e"][ids]
        return np.concatenate([self.run(x, "f"), self.run(x, "b")], axis=2) @ self.w["o"] + self.w["c"]

    def forward(self, e: np.ndarray) -> np.ndarray:
        a = np.empty_like(e)
        a[0] = e[0]
        for t in range(1, len(e)):
            a[t] = logsum(a[t - 1][:, :, None] + self.w["t"], 1) + e[t]
        return a

    def backward(self, e: np.ndarray) -> np.ndarray:
        b = np.zeros_like(e)
        for t in range(len(e) - 2, -1, -1):
            b[t] = logsum(self.w["t"] + (e[t + 1] + b[t + 1])[:, None, :], 2)
        return b

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tag path (time, batch) and the marginal probability of each of its tags."""
        e = self.emissions(ids)
        best, back = e[0], []
        for t in range(1, len(e)):
            s = best[:, :, None] + self.w["t"]
            back.append(s.argmax(axis=1))
            best = s.max(axis=1) + e[t]
        path = [best.argmax(axis=1)]
        for b in reversed(back):
            path.append(np.take_along_axis(b, path[-1][:, None], 1)[:, 0])
        path_ = np.array(path[::-1])
        ab = self.forward(e) + self.backward(e)
        ab -= logsum(ab, 2)[:, :, None]
        return path_, np.exp(np.take_along_axis(ab, path_[:, :, None], 2)[:, :, 0])

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tag paths, and its gradients."""
        w, n, batch = self.w, self.hidden, ids.shape[1]
        x = w["e"][ids]
        kept: dict[str, list] = {"f": [], "b": []}
        h = np.concatenate([self.run(x, d, kept[d]) for d in "fb"], axis=2)
        e = h @ w["o"] + w["c"]
        a, b = self.forward(e), self.backward(e)
        z = logsum(a[-1], 1)
        gold = np.take_along_axis(e, tags[:, :, None], 2)[:, :, 0].sum(0) + w["t"][tags[:-1], tags[1:]].sum(0)
        de = np.exp(a + b - z[:, None])
        np.put_along_axis(de, tags[:, :, None], np.take_along_axis(de, tags[:, :, None], 2) - 1, 2)
        g = {"t": np.exp(a[:-1, :, :, None] + w["t"] + (e[1:] + b[1:])[:, :, None, :] - z[:, None, None]).sum((0, 1))}
        np.add.at(g["t"], (tags[:-1].ravel(), tags[1:].ravel()), -1)
        g |= {"o": np.tensordot(h, de, ((0, 1), (0, 1))), "c": de.sum((0, 1))}
        dh_all = de @ w["o"].T
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            wh = w[f"h{d}"]
            dz_all, dwh = np.zeros((*ids.shape, 4 * n)), np.zeros_like(wh)
            dh, dc = np.zeros((batch, n)), np.zeros((batch, n))
            for t, i, f, o, cand, before, h_before, tc in reversed(kept[d]):
                dh = dh + dh_all[t][:, k * n : (k + 1) * n]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * cand * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - cand * cand)], axis=1)
                dz_all[t] = dz
                dwh += h_before.T @ dz
                dh, dc = dz @ wh.T, dc * f
            g |= {f"h{d}": dwh, f"x{d}": np.tensordot(x, dz_all, ((0, 1), (0, 1))), f"b{d}": dz_all.sum((0, 1))}
            dx += dz_all @ w[f"x{d}"].T
        g["e"] = np.zeros_like(w["e"])
        np.add.at(g["e"], ids, dx)
        return float((z - gold).mean()), {k: v / batch for k, v in g.items()}

    def train(self, ids: np.ndarray, tags: np.ndarray, steps: int, batch: int = 48, rate: float = 0.01, seed: int = 6) -> CharTagger:
        """ids, tags: (window, time)."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        for step in range(1, steps + 1):
            chosen = rng.integers(0, len(ids), batch)
            _, g = self.gradients(ids[chosen].T, tags[chosen].T)
            norm = max(1.0, np.sqrt(sum((x * x).sum() for x in g.values())) / 5)
            now = rate * (1 - 0.9 * step / steps)
            for k, x in g.items():
                x = x / norm
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                self.w[k] = self.w[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self
