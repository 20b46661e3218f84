"""A small bidirectional gated recurrent network with attention pooling, in numpy.

Characters: a bidirectional GRU reads each distinct word once. Words: a bidirectional GRU reads the
word's embedding and character state over a window; attention pools its states into one logit.
Arrays are time first; masks are 1 for real steps and 0 for padding.
"""

from __future__ import annotations

import numpy as np

CHARS = 512  # characters are taken modulo this
PIECE = 32  # longer words are read in pieces of so many characters


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def gru_forward(xp, u, mask, keep=False):
    """States of a GRU. ``xp``: projected inputs (T, B, 3H); ``u``: (H, 3H)."""
    steps, batch, width = xp.shape
    hidden = width // 3
    h = np.zeros((batch, hidden), xp.dtype)
    states, cache = [], []
    for t in range(steps):
        hu = h @ u
        zr = _sigmoid(xp[t, :, : 2 * hidden] + hu[:, : 2 * hidden])
        z, r = zr[:, :hidden], zr[:, hidden:]
        hn = hu[:, 2 * hidden :]
        n = np.tanh(xp[t, :, 2 * hidden :] + r * hn)
        m = mask[t][:, None]
        new = h + m * (1 - z) * (n - h)
        if keep:
            cache.append((h, z, r, n, hn, m))
        states.append(new)
        h = new
    return np.stack(states), cache


def gru_backward(d_states, u, cache):
    """Gradients of the projected inputs and of ``u``."""
    steps, batch, hidden = d_states.shape
    d_xp = np.zeros((steps, batch, 3 * hidden), d_states.dtype)
    d_u = np.zeros_like(u)
    d_h = np.zeros((batch, hidden), d_states.dtype)
    for t in reversed(range(steps)):
        h, z, r, n, hn, m = cache[t]
        d = d_h + d_states[t]
        dm = d * m
        d_n = dm * (1 - z) * (1 - n * n)
        d_z = dm * (h - n) * z * (1 - z)
        d_r = d_n * hn * r * (1 - r)
        d_hu = np.concatenate([d_z, d_r, d_n * r], axis=1)
        d_xp[t] = np.concatenate([d_z, d_r, d_n], axis=1)
        d_u += h.T @ d_hu
        d_h = d - dm * (1 - z) + d_hu @ u.T
    return d_xp, d_u


def word_pieces(words):
    """Long words become several, so that no word needs more than PIECE steps."""
    out = []
    for w in words:
        if len(w) <= PIECE:
            out.append(w)
        else:
            out += [w[i : i + PIECE] for i in range(0, len(w), PIECE)]
    return out


class Network:
    """Parameters and passes. ``vocabulary``: word -> row of the embedding; row 0 is for all others."""

    def __init__(self, vocabulary: dict[str, int], params: dict[str, np.ndarray]):
        self.vocabulary, self.params = vocabulary, params

    @classmethod
    def start(cls, vocabulary, embed=12, char_embed=8, char_hidden=6, hidden=8, attention=8, seed=0):
        rng = np.random.default_rng(seed)

        def init(*shape):
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        width = embed + 2 * char_hidden
        params = {
            "embed": np.zeros((len(vocabulary) + 1, embed), np.float32),
            "chars": (0.3 * rng.standard_normal((CHARS, char_embed))).astype(np.float32),
            "att_v": init(attention, 1)[:, 0],
            "att_w": init(2 * hidden, attention),
            "out_w": init(2 * hidden, 1)[:, 0],
            "out_b": np.zeros(1, np.float32),
        }
        params["embed"][0] = 0
        for d in "fb":
            params |= {
                f"c_w{d}": init(char_embed, 3 * char_hidden), f"c_b{d}": np.zeros(3 * char_hidden, np.float32),
                f"c_u{d}": init(char_hidden, 3 * char_hidden), f"w_w{d}": init(width, 3 * hidden),
                f"w_b{d}": np.zeros(3 * hidden, np.float32), f"w_u{d}": init(hidden, 3 * hidden),
            }
        return cls(vocabulary, params)

    # words -----------------------------------------------------------------------------------------

    def _spell(self, words):
        lengths = np.array([len(w) for w in words])
        codes = np.zeros((lengths.max(), len(words)), np.int64)
        step = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        codes[step, np.repeat(np.arange(len(words)), lengths)] = letters % CHARS
        return codes, (np.arange(len(codes))[:, None] < lengths).astype(np.float32)

    def word_vectors(self, words, keep=False):
        """Embedding and both final character states of each word."""
        p = self.params
        codes, mask = self._spell(words)
        x = p["chars"][codes]
        ends, caches = [], []
        for d in "fb":
            order = slice(None) if d == "f" else slice(None, None, -1)
            states, cache = gru_forward(x[order] @ p[f"c_w{d}"] + p[f"c_b{d}"], p[f"c_u{d}"], mask[order], keep)
            ends.append(states[-1])
            caches.append(cache)
        rows = np.array([self.vocabulary.get(w, 0) for w in words])
        vectors = np.concatenate([p["embed"][rows], *ends], axis=1)
        return vectors, (codes, mask, x, caches, rows)

    def projections(self, words):
        """Inputs of the word GRU, forward and backward side by side, for words as they come."""
        size = 2 * self.params["w_wf"].shape[1]
        out = np.zeros((len(words), size), np.float32)
        by_length = sorted(range(len(words)), key=lambda i: len(words[i]))
        for at in range(0, len(words), 2048):
            some = by_length[at : at + 2048]
            vectors, _ = self.word_vectors([words[i] for i in some])
            out[some] = np.concatenate([vectors @ self.params[f"w_w{d}"] + self.params[f"w_b{d}"] for d in "fb"], axis=1)
        return out

    # windows ---------------------------------------------------------------------------------------

    def _pool(self, states, mask):
        p = self.params
        u = np.tanh(states @ p["att_w"])
        s = np.where(mask > 0, u @ p["att_v"], -1e9)
        e = np.exp(s - s.max(axis=0)) * mask
        a = e / np.maximum(e.sum(axis=0), 1e-9)
        context = (a[:, :, None] * states).sum(axis=0)
        return context @ p["out_w"] + p["out_b"][0], (u, a, context)

    def logits(self, table, index, mask):
        """Logits of windows: ``index`` (T, B) rows of ``table`` as made by ``projections``."""
        half = table.shape[1] // 2
        forward, _ = gru_forward(table[index, :half], self.params["w_uf"], mask)
        backward, _ = gru_forward(table[index[::-1], half:], self.params["w_ub"], mask[::-1])
        return self._pool(np.concatenate([forward, backward[::-1]], axis=2), mask)[0]

    def gradients(self, words, index, mask, labels):
        """Gradients of the mean cross-entropy of windows over distinct ``words``."""
        p, g = self.params, {}
        vectors, (codes, spelled, x, char_caches, rows) = self.word_vectors(words, keep=True)
        states, caches = [], []
        for d in "fb":
            order = slice(None) if d == "f" else slice(None, None, -1)
            table = vectors @ p[f"w_w{d}"] + p[f"w_b{d}"]
            h, cache = gru_forward(table[index[order]], p[f"w_u{d}"], mask[order], keep=True)
            states.append(h[order])
            caches.append(cache)
        h = np.concatenate(states, axis=2)
        logit, (u, a, context) = self._pool(h, mask)
        d_logit = ((_sigmoid(logit) - labels) / len(labels)).astype(np.float32)
        g["out_w"], g["out_b"] = context.T @ d_logit, np.array([d_logit.sum()], np.float32)
        d_context = d_logit[:, None] * p["out_w"]
        d_h = a[:, :, None] * d_context
        d_a = (h * d_context).sum(axis=2)
        d_s = a * (d_a - (a * d_a).sum(axis=0))
        g["att_v"] = (u * d_s[:, :, None]).sum(axis=(0, 1))
        d_u = d_s[:, :, None] * p["att_v"] * (1 - u * u)
        g["att_w"] = np.tensordot(h, d_u, ([0, 1], [0, 1]))
        d_h = d_h + d_u @ p["att_w"].T
        half = h.shape[2] // 2
        d_vectors = np.zeros_like(vectors)
        flat = {"f": index.ravel(), "b": index[::-1].ravel()}
        for d, part, cache in zip("fb", (d_h[:, :, :half], d_h[::-1, :, half:]), caches):
            d_xp, g[f"w_u{d}"] = gru_backward(part, p[f"w_u{d}"], cache)
            d_table = np.zeros((len(words), d_xp.shape[2]), np.float32)
            np.add.at(d_table, flat[d], d_xp.reshape(-1, d_xp.shape[2]))
            g[f"w_w{d}"], g[f"w_b{d}"] = vectors.T @ d_table, d_table.sum(axis=0)
            d_vectors += d_table @ p[f"w_w{d}"].T
        embed = p["embed"].shape[1]
        g["embed"] = np.zeros_like(p["embed"])
        np.add.at(g["embed"], rows, d_vectors[:, :embed])
        g["embed"][0] = 0
        g["chars"] = np.zeros_like(p["chars"])
        wide = (d_vectors.shape[1] - embed) // 2
        for i, d in enumerate("fb"):
            order = slice(None) if d == "f" else slice(None, None, -1)
            d_states = np.zeros((*codes.shape, wide), np.float32)
            d_states[-1] = d_vectors[:, embed + i * wide : embed + (i + 1) * wide]
            d_xp, g[f"c_u{d}"] = gru_backward(d_states, p[f"c_u{d}"], char_caches[i])
            g[f"c_w{d}"] = np.tensordot(x[order], d_xp, ([0, 1], [0, 1]))
            g[f"c_b{d}"] = d_xp.sum(axis=(0, 1))
            np.add.at(g["chars"], codes[order].ravel(), (d_xp @ p[f"c_w{d}"].T).reshape(-1, x.shape[2]))
        return g


class Adam:
    def __init__(self, params, rate=0.01):
        self.params, self.rate, self.steps = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads):
        self.steps += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, 5.0 / max(norm, 1e-9))
        for k, g in grads.items():
            g = g * scale
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            m, v = self.m[k] / (1 - 0.9**self.steps), self.v[k] / (1 - 0.999**self.steps)
            self.params[k] -= (self.rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
