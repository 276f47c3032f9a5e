"""A character-level bidirectional LSTM with a CRF on top, trained and run in numpy.

Tags are O and, per kind, a begin and an inside tag.  Training maximises the
CRF's likelihood of labelled windows; running gives the marginal probability
of every tag at every character of a window.
"""

from __future__ import annotations

import numpy as np

from .pii_rules import LABELS

TAGS = 1 + 2 * len(LABELS)
EMBEDDING, HIDDEN = 12, 16
EPOCHS, BATCH, RATE = 24, 64, 0.01
#: Character classes: padding, printable ASCII, line breaks and tabs, other letters, the rest.
CLASSES = 100


def char_classes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    out = np.where((code >= 32) & (code < 127), code - 31, 99)
    out[(code >= 9) & (code <= 13)] = 97
    out[(code >= 0xC0) & (code < 0x2000)] = 98
    return out


def allowed() -> np.ndarray:
    """1 where a tag may follow another: an inside tag needs the same kind before it."""
    ok = np.ones((TAGS, TAGS), bool)
    for kind in range(len(LABELS)):
        inside = 2 + 2 * kind
        ok[:, inside] = False
        ok[[inside - 1, inside], inside] = True
    return ok


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
        self.p = {"emb": draw(CLASSES, EMBEDDING), "out": draw(2 * HIDDEN, TAGS), "out_b": np.zeros(TAGS, np.float32),
                  "trans": np.zeros((TAGS, TAGS), np.float32)}
        for side in "fb":
            self.p |= {f"wx_{side}": draw(EMBEDDING, 4 * HIDDEN), f"wh_{side}": draw(HIDDEN, 4 * HIDDEN),
                       f"b_{side}": np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)]).astype(np.float32)}
        self.ok = allowed()

    def _lstm(self, chars: np.ndarray, side: str) -> tuple[np.ndarray, list]:
        """States (time, batch, hidden); gates lie in the order forget, input, output, candidate."""
        steps, batch = chars.shape
        table = self.p["emb"] @ self.p[f"wx_{side}"] + self.p[f"b_{side}"]
        wh, h, c = self.p[f"wh_{side}"], np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
        out, kept = np.empty((steps, batch, HIDDEN), np.float32), [None] * steps
        for t in (range(steps) if side == "f" else reversed(range(steps))):
            raw = table[chars[t]] + h @ wh
            gate, new = _sigmoid(raw[:, :3 * HIDDEN]), np.tanh(raw[:, 3 * HIDDEN:])
            before, last = c, h
            c = gate[:, :HIDDEN] * before + gate[:, HIDDEN:2 * HIDDEN] * new
            top = np.tanh(c)
            h = gate[:, 2 * HIDDEN:] * top
            out[t], kept[t] = h, (gate, new, before, last, top)
        return out, kept

    def _lstm_back(self, chars: np.ndarray, side: str, kept: list, dout: np.ndarray, grad: dict) -> None:
        steps, batch = chars.shape
        wh = self.p[f"wh_{side}"]
        dh, dc = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
        draws = np.empty((steps, batch, 4 * HIDDEN), np.float32)
        for t in (reversed(range(steps)) if side == "f" else range(steps)):
            gate, new, before, last, top = kept[t]
            f, i, o = gate[:, :HIDDEN], gate[:, HIDDEN:2 * HIDDEN], gate[:, 2 * HIDDEN:]
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - top**2)
            draw = np.concatenate([dc * before * f * (1 - f), dc * new * i * (1 - i), dh * top * o * (1 - o), dc * i * (1 - new**2)], axis=1)
            grad[f"wh_{side}"] += last.T @ draw
            draws[t] = draw
            dh, dc = draw @ wh.T, dc * f
        table = np.zeros((CLASSES, 4 * HIDDEN), np.float32)
        np.add.at(table, chars.ravel(), draws.reshape(-1, 4 * HIDDEN))
        grad[f"b_{side}"] += table.sum(axis=0)
        grad[f"wx_{side}"] += self.p["emb"].T @ table
        grad["emb"] += table @ self.p[f"wx_{side}"].T

    def _crf(self, emission: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals (time, batch, tag), and expected transitions summed over time and batch."""
        steps, batch, _ = emission.shape
        local = np.exp(emission - emission.max(axis=2, keepdims=True)).astype(np.float64)
        move = np.where(self.ok, np.exp(self.p["trans"].astype(np.float64)), 0)
        ahead, back = np.empty_like(local), np.empty_like(local)
        ahead[0] = local[0] / local[0].sum(axis=1, keepdims=True)
        for t in range(1, steps):
            ahead[t] = (ahead[t - 1] @ move) * local[t]
            ahead[t] /= ahead[t].sum(axis=1, keepdims=True)
        back[-1] = 1
        for t in range(steps - 2, -1, -1):
            back[t] = (back[t + 1] * local[t + 1]) @ move.T
            back[t] /= back[t].sum(axis=1, keepdims=True)
        marginal = ahead * back
        marginal /= marginal.sum(axis=2, keepdims=True)
        moved = np.zeros((TAGS, TAGS))
        for t in range(1, steps):
            right = local[t] * back[t]
            total = ((ahead[t - 1] @ move) * right).sum(axis=1, keepdims=True)
            moved += (ahead[t - 1] / total).T @ right * move
        return marginal, moved

    def _emission(self, chars: np.ndarray):
        forward, kept_f = self._lstm(chars, "f")
        backward, kept_b = self._lstm(chars, "b")
        state = np.concatenate([forward, backward], axis=2)
        return state @ self.p["out"] + self.p["out_b"], state, kept_f, kept_b

    def marginals(self, windows: np.ndarray) -> np.ndarray:
        """(window, position, tag) probabilities of windows of character classes."""
        return self.read(windows)[0]

    def read(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, position, tag): the probabilities, and the emission scores that precede the transitions."""
        emission, *_ = self._emission(np.ascontiguousarray(windows.T))
        return self._crf(emission)[0].transpose(1, 0, 2).astype(np.float32), emission.transpose(1, 0, 2)

    def train(self, windows: np.ndarray, tags: np.ndarray, seed: int = 0, epochs: int = EPOCHS) -> Tagger:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for a in range(0, len(order), BATCH):
                pick = order[a:a + BATCH]
                chars, gold = np.ascontiguousarray(windows[pick].T), tags[pick].T
                emission, state, kept_f, kept_b = self._emission(chars)
                marginal, moved = self._crf(emission)
                error = marginal.astype(np.float32)
                np.put_along_axis(error, gold[:, :, None], np.take_along_axis(error, gold[:, :, None], 2) - 1, 2)
                grad = {k: np.zeros_like(v) for k, v in self.p.items()}
                np.subtract.at(moved, (gold[:-1].ravel(), gold[1:].ravel()), 1)
                grad["trans"] = np.where(self.ok, moved, 0).astype(np.float32)
                flat = error.reshape(-1, TAGS)
                grad["out"], grad["out_b"] = state.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(axis=0)
                dstate = error @ self.p["out"].T
                self._lstm_back(chars, "f", kept_f, dstate[:, :, :HIDDEN], grad)
                self._lstm_back(chars, "b", kept_b, dstate[:, :, HIDDEN:], grad)
                step += 1
                size = np.sqrt(sum(float((g**2).sum()) for g in grad.values())) / len(pick)
                for k, g in grad.items():
                    g = g / len(pick) * min(1, 5 / max(size, 1e-9))
                    m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.999 * s[k] + 0.001 * g**2
                    self.p[k] -= (RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def decode(score: np.ndarray, ok: np.ndarray, trans: np.ndarray | None = None) -> np.ndarray:
    """The best allowed tag sequence under scores (time, tag) and transition scores (from, to); the first tag is no inside tag."""
    steps = len(score)
    barred = np.where(ok, 0.0 if trans is None else trans, -1e9)
    best = score[0] + np.where(np.arange(TAGS) % 2 == 0, -1e9 * (np.arange(TAGS) > 0), 0)
    came = np.zeros((steps, TAGS), np.int8)
    for t in range(1, steps):
        way = best[:, None] + barred
        came[t] = way.argmax(axis=0)
        best = way[came[t], np.arange(TAGS)] + score[t]
    out = np.empty(steps, np.int8)
    out[-1] = best.argmax()
    for t in range(steps - 1, 0, -1):
        out[t - 1] = came[t, out[t]]
    return out
