"""A character-level bidirectional LSTM with a CRF on top, in numpy.

Both directions run side by side as one batched matrix product; the input weights
are looked up by character class, so no embedding product is needed. ``fit``
follows the exact gradient (CRF forward-backward, then back-propagation through
time) with Adam; ``decode`` gives the best label path of each row under the CRF,
in which an inside label may only follow its own kind.
"""

from __future__ import annotations

import numpy as np

#: Character classes: 0 pads, 1..95 printable ASCII, 96 blanks, 97 other letters, 98 anything else.
CLASSES = 99
DIGITS = ord("0") - 31  #: class of the digit 0


def classes(text: str) -> np.ndarray:
    """The class of every code point."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.where((cp >= 32) & (cp < 127), cp - 31, np.where(cp < 32, 96, np.where(cp >= 0xC0, 97, 98)))
    return out.astype(np.uint8)


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """Labels 0 (outside), then 2k+1 (begin) and 2k+2 (inside) of kind k."""

    def __init__(self, kinds: int, hidden: int = 32, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = 2 * kinds + 1, hidden
        k, h = self.labels, hidden

        def draw(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"x": draw(2, CLASSES, 4 * h, scale=0.3), "u": draw(2, h, 4 * h, scale=1 / np.sqrt(h)),
                  "b": np.zeros((2, 4 * h), np.float32), "o": draw(2 * h, k, scale=1 / np.sqrt(2 * h)),
                  "c": np.zeros(k, np.float32), "t": np.zeros((k, k), np.float32),
                  "s": np.zeros(k, np.float32), "e": np.zeros(k, np.float32)}
        self.p["b"][:, h:2 * h] = 1.0  # forget gates start open

    def _states(self, codes: np.ndarray, keep: bool = False):
        """Hidden states [2, time, rows, hidden] (second direction in reversed time)."""
        p, h = self.p, self.hidden
        rows, time = codes.shape
        both = np.stack([codes.T, codes[:, ::-1].T])
        hs = np.zeros((2, time + 1, rows, h), np.float32)
        c = np.zeros((2, rows, h), np.float32)
        gates, cells = [], [c]
        for t in range(time):
            z = np.stack([p["x"][0, both[0, t]], p["x"][1, both[1, t]]]) + hs[:, t] @ p["u"] + p["b"][:, None]
            ifo, g = _sigmoid(z[..., :3 * h]), np.tanh(z[..., 3 * h:])
            c = ifo[..., h:2 * h] * c + ifo[..., :h] * g
            hs[:, t + 1] = ifo[..., 2 * h:] * np.tanh(c)
            if keep:
                gates.append((ifo, g))
                cells.append(c)
        return both, hs, gates, cells

    def _emissions(self, hs: np.ndarray) -> np.ndarray:
        """Label scores [time, rows, labels]."""
        h = self.hidden
        return hs[0, 1:] @ self.p["o"][:h] + hs[1, :0:-1] @ self.p["o"][h:] + self.p["c"]

    def _crf(self, em: np.ndarray, gold: np.ndarray):
        """Mean loss, and the gradients for emissions, transitions, start and end."""
        p, (time, rows, k) = self.p, em.shape
        alpha = np.empty_like(em)
        beta = np.empty_like(em)
        alpha[0] = p["s"] + em[0]

        def lse(a, axis):
            m = a.max(axis=axis, keepdims=True)
            return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis=axis))
        for t in range(1, time):
            alpha[t] = lse(alpha[t - 1][:, :, None] + p["t"], 1) + em[t]
        beta[-1] = p["e"]
        for t in range(time - 2, -1, -1):
            beta[t] = lse(p["t"] + (em[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1] + p["e"], 1)
        post = np.exp(alpha + beta - z[:, None])
        pair = np.exp(alpha[:-1, :, :, None] + p["t"] + (em[1:] + beta[1:])[:, :, None, :] - z[:, None, None])
        hot = np.eye(k, dtype=np.float32)[gold]
        score = ((em * hot).sum((0, 2)) + p["s"][gold[0]] + p["e"][gold[-1]] + p["t"][gold[:-1], gold[1:]].sum(0))
        seen = np.zeros((k, k), np.float32)
        np.add.at(seen, (gold[:-1].ravel(), gold[1:].ravel()), 1)
        return (float((z - score).mean()), (post - hot) / rows, (pair.sum((0, 1)) - seen) / rows,
                (post[0] - hot[0]).mean(0), (post[-1] - hot[-1]).mean(0))

    def gradient(self, codes: np.ndarray, gold: np.ndarray):
        """(mean loss, gradient of each parameter) of rows of codes and their labels."""
        p, h = self.p, self.hidden
        both, hs, gates, cells = self._states(codes, keep=True)
        loss, dem, dt, ds, de = self._crf(self._emissions(hs), gold.T)
        time, rows, k = dem.shape
        fore, back = hs[0, 1:].reshape(-1, h), hs[1, :0:-1].reshape(-1, h)
        flat = dem.reshape(-1, k)
        out = {"o": np.vstack([fore.T @ flat, back.T @ flat]), "c": flat.sum(0), "t": dt, "s": ds, "e": de}
        dh_out = np.stack([dem @ p["o"][:h].T, (dem @ p["o"][h:].T)[::-1]])
        dz = np.empty((2, time, rows, 4 * h), np.float32)
        dh = np.zeros((2, rows, h), np.float32)
        dc = np.zeros_like(dh)
        ut = p["u"].transpose(0, 2, 1)
        for t in range(time - 1, -1, -1):
            ifo, g = gates[t]
            i, f, o = ifo[..., :h], ifo[..., h:2 * h], ifo[..., 2 * h:]
            tc = np.tanh(cells[t + 1])
            dh = dh + dh_out[:, t]
            dc = dc + dh * o * (1 - tc * tc)
            d = dz[:, t]
            d[..., :h] = dc * g * i * (1 - i)
            d[..., h:2 * h] = dc * cells[t] * f * (1 - f)
            d[..., 2 * h:3 * h] = dh * tc * o * (1 - o)
            d[..., 3 * h:] = dc * i * (1 - g * g)
            dc = dc * f
            dh = d @ ut
        out["b"] = dz.sum((1, 2))
        out["u"] = np.stack([hs[d, :-1].reshape(-1, h).T @ dz[d].reshape(-1, 4 * h) for d in (0, 1)])
        hot = np.zeros((time * rows, CLASSES), np.float32)
        out["x"] = np.empty_like(p["x"])
        for d in (0, 1):
            hot[:] = 0
            hot[np.arange(time * rows), both[d].ravel()] = 1
            out["x"][d] = hot.T @ dz[d].reshape(-1, 4 * h)
        return loss, out

    def fit(self, codes: np.ndarray, gold: np.ndarray, steps: int, rows: int = 64, rate: float = 0.02,
            seed: int = 11) -> list[float]:
        """Adam over random batches, with half of the rows' digits drawn anew each time; the losses of the steps."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        losses, order = [], np.empty(0, int)
        for step in range(1, steps + 1):
            if len(order) < rows:
                order = np.concatenate([order, rng.permutation(len(codes))])
            take, order = order[:rows], order[rows:]
            drawn = codes[take]
            digits = (drawn >= DIGITS) & (drawn < DIGITS + 10) & (rng.random((rows, 1)) < 0.5)
            drawn[digits] = rng.integers(DIGITS, DIGITS + 10, int(digits.sum()))
            loss, grad = self.gradient(drawn, gold[take])
            losses.append(loss)
            size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            cut = min(1.0, 5.0 / max(size, 1e-9))
            pace = rate * min(1.0, step / 20) * (0.05 + 0.95 * (1 - step / steps))
            for k, g in grad.items():
                g = g * cut
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.p[k] -= (pace * (m[k] / (1 - 0.9 ** step))
                              / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
        return losses

    def decode(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best labels [rows, time] and, per place, how far the chosen label's score leads the outside label's."""
        _, hs, _, _ = self._states(codes)
        em = self._emissions(hs)
        time, rows, k = em.shape
        trans, start = self.p["t"].copy(), self.p["s"].copy()
        for inside in range(2, k, 2):
            barred = np.ones(k, bool)
            barred[[inside - 1, inside]] = False
            trans[barred, inside] = -1e4
            start[inside] = -1e4
        best = start + em[0]
        back = np.empty((time, rows, k), np.int8)
        for t in range(1, time):
            path = best[:, :, None] + trans
            back[t] = path.argmax(1)
            best = np.take_along_axis(path, back[t][:, None].astype(np.int64), 1)[:, 0] + em[t]
        labels = np.empty((rows, time), np.int8)
        at = (best + self.p["e"]).argmax(1)
        for t in range(time - 1, -1, -1):
            labels[:, t] = at
            if t:
                at = back[t][np.arange(rows), at]
        lead = np.take_along_axis(em.transpose(1, 0, 2), labels[..., None].astype(np.int64), 2)[..., 0] - em[..., 0].T
        return labels, lead
