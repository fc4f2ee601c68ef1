"""A small causal self-attention model in numpy: one head over words, each the mean of its subwords, to classes of a word's first subword."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Width of the model, positions of a window, positions by which windows advance, classes of the output.
DIM, WINDOW, STRIDE, CLASSES = 16, 32, 24, 64
NAMES = ("emb", "pos", "wq", "wk", "wv", "wo", "w1", "w2", "out", "bias")


def shapes(vocab: int, dim: int = DIM, window: int = WINDOW, classes: int = CLASSES) -> dict[str, tuple[int, ...]]:
    return {"emb": (vocab, dim), "pos": (window, dim), **{n: (dim, dim) for n in ("wq", "wk", "wv", "wo")}, "w1": (dim, 2 * dim), "w2": (2 * dim, dim), "out": (dim, classes), "bias": (classes,)}


def initial(vocab: int, seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    return {n: (np.zeros(s) if n in ("bias", "wo", "w2") else rng.standard_normal(s) * (0.3 if n in ("emb", "pos") else s[0] ** -0.5)).astype(np.float32) for n, s in shapes(vocab).items()}


@dataclass
class Windows:
    """Overlapping windows of sequences: ids of the inputs, their targets, and which targets a window scores."""

    inputs: np.ndarray
    targets: np.ndarray
    scored: np.ndarray
    owner: np.ndarray


def windows(ids: np.ndarray, lengths: np.ndarray, start_id: int, window: int = WINDOW, stride: int = STRIDE) -> Windows:
    """Windows over sequences that lie one after another in ids, each predicted from start_id and what precedes.

    A sequence's first window scores all its positions, the later ones those past the overlap, so each token is scored
    once, with at least window - stride positions before it. ids are words, numbered as their rows are.
    """
    lengths = lengths.astype(np.int64)
    begin = np.cumsum(lengths) - lengths
    count = np.maximum(1, 1 + -(-(lengths - window) // stride)) * (lengths > 0)
    owner = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = (nth * stride)[:, None] + np.arange(window)
    inside = at < lengths[owner][:, None]
    where = np.minimum(begin[owner][:, None] + at, max(len(ids) - 1, 0))
    targets = ids[where]
    inputs = np.empty_like(targets)
    inputs[:, 1:] = targets[:, :-1]
    inputs[:, 0] = np.where(nth == 0, start_id, ids[where[:, 0] - 1]) if len(owner) else 0
    return Windows(inputs, targets, inside & ((nth == 0)[:, None] | (np.arange(window) >= window - stride)), owner)


_MASK: dict[int, np.ndarray] = {}


def causal(t: int) -> np.ndarray:
    if t not in _MASK:
        _MASK[t] = np.triu(np.full((t, t), -1e4, np.float32), 1)
    return _MASK[t]


def hidden(p: dict[str, np.ndarray], x: np.ndarray, keep: bool = False):
    """Last layer before the output, (windows * positions, dim), from the words' rows (windows, positions, dim); with
    keep, what backpropagation needs too."""
    b, t, d = x.shape
    flat = (x + p["pos"][:t]).reshape(b * t, d)
    qkv = (flat @ fused(p)).reshape(b, t, 3 * d)
    q, k, v = qkv[:, :, :d], qkv[:, :, d : 2 * d], qkv[:, :, 2 * d :]
    a = np.matmul(q, k.transpose(0, 2, 1))
    np.clip(a, -60, 30, out=a)  # keeps exp in range, and its sums above 0, without a pass for the maximum
    a += causal(t)
    np.exp(a, out=a)
    a /= (a.reshape(b * t, t) @ np.ones(t, a.dtype)).reshape(b, t, 1)
    mixed = np.matmul(a, v).reshape(b * t, d)
    h1 = flat + mixed @ p["wo"]
    z = h1 @ p["w1"]
    np.maximum(z, 0, out=z)
    h2 = h1 + z @ p["w2"]
    return (h2, (flat, q, k, v, a, mixed, h1, z)) if keep else h2


def class_probs(p: dict[str, np.ndarray], h: np.ndarray) -> np.ndarray:
    e = h @ p["out"]
    e += p["bias"]
    np.clip(e, -40, 40, out=e)  # no class's probability is lost to rounding
    np.exp(e, out=e)
    return e


def fused(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p["wq"] * np.float32(p["wq"].shape[0] ** -0.5), p["wk"], p["wv"]], axis=1)


def log_scores(p: dict[str, np.ndarray], w: Windows, table: np.ndarray, classes: np.ndarray, within: np.ndarray, chunk: int = 32) -> np.ndarray:
    """Natural log probabilities of all scored targets, in the order of w.scored's true entries.

    By words, table has their rows, classes those of their first subwords, and within what a word's log probability
    has besides its class's.

    The same function as hidden and class_probs, arranged for speed: chunks that fit a core's cache, the attention's
    denominator applied after the values are mixed, and the output layer for scored positions only.
    """
    out = []
    d, t = p["wq"].shape[0], w.inputs.shape[1]
    qkv_w, mask, emb, pos = fused(p), causal(t), table, p["pos"][:t]
    one, ones = np.ones(t, np.float32), np.ones(len(p["bias"]), np.float32)  # row sums as products
    for k in range(0, len(w.inputs), chunk):
        x = w.inputs[k : k + chunk]
        b = len(x)
        h = emb.take(x, axis=0)
        h += pos
        h = h.reshape(b * t, d)
        qkv = (h @ qkv_w).reshape(b, t, 3 * d)
        a = np.matmul(qkv[:, :, :d], qkv[:, :, d : 2 * d].transpose(0, 2, 1))
        np.clip(a, -60, 30, out=a)
        a += mask
        np.exp(a, out=a)
        mixed = np.matmul(a, qkv[:, :, 2 * d :])
        mixed /= (a.reshape(b * t, t) @ one).reshape(b, t, 1)
        rows = np.flatnonzero(w.scored[k : k + chunk])
        h = h.take(rows, axis=0)
        h += mixed.reshape(b * t, d).take(rows, axis=0) @ p["wo"]
        z = h @ p["w1"]
        np.maximum(z, 0, out=z)
        h += z @ p["w2"]
        y = w.targets[k : k + chunk].take(rows)
        e = class_probs(p, h)
        own = e.take(np.arange(0, e.size, e.shape[1]) + classes.take(y))
        out.append(np.log(own / (e @ ones)) + within.take(y))
    return np.concatenate(out) if out else np.zeros(0, np.float32)


def gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, scored: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss (nats a word, of its class y) and its gradients; "rows" is that of the words' rows x."""
    b, t, d = x.shape
    h2, (flat, q, k, v, a, mixed, h1, z) = hidden(p, x, keep=True)
    e = class_probs(p, h2)
    y, kind = y.ravel(), h2.dtype
    share = 1 / (e @ np.ones(e.shape[1], kind))  # row sums as products
    weight = scored.ravel().astype(kind) / kind.type(max(1, int(scored.sum())))
    own = np.arange(0, e.size, e.shape[1]) + y
    loss = float(-(np.log(e.take(own) * share) * weight).sum())
    e *= (share * weight)[:, None]
    e.ravel()[own] -= weight
    g = {"out": h2.T @ e, "bias": np.ones(len(e), kind) @ e}
    dh = e @ p["out"].T
    g["w2"] = z.T @ dh
    dz = dh @ p["w2"].T
    dz *= z > 0
    g["w1"] = h1.T @ dz
    dh += dz @ p["w1"].T
    g["wo"] = mixed.T @ dh
    dm = (dh @ p["wo"].T).reshape(b, t, d)
    da = np.matmul(dm, v.transpose(0, 2, 1))
    da -= ((da * a).reshape(b * t, t) @ np.ones(t, kind)).reshape(b, t, 1)
    da *= a
    parts = (np.matmul(da, k), np.matmul(da.transpose(0, 2, 1), q), np.matmul(a.transpose(0, 2, 1), dm))
    dqkv = np.concatenate(parts, axis=2).reshape(b * t, 3 * d)
    dh += dqkv @ fused(p).T
    g["wq"], g["wk"], g["wv"] = np.split(flat.T @ dqkv, 3, axis=1)
    g["wq"] *= kind.type(d**-0.5)
    g["pos"] = np.zeros_like(p["pos"])
    g["pos"][:t] = dh.reshape(b, t, d).sum(axis=0)
    g["rows"] = dh
    return loss, g


class Adam:
    """Adam over some of the parameters, in place."""

    def __init__(self, p: dict[str, np.ndarray], names: tuple[str, ...]):
        self.p, self.n = {k: p[k] for k in names}, 0
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.n += 1
        lr = np.float32(rate * np.sqrt(1 - 0.99**self.n) / (1 - 0.9**self.n))
        for k, w in self.p.items():
            m, v = self.m[k], self.v[k]
            m += np.float32(0.1) * (g[k] - m)
            v += np.float32(0.01) * (g[k] * g[k] - v)
            w -= lr * m / (np.sqrt(v) + np.float32(1e-8))


def group(beside: np.ndarray, counts: np.ndarray, classes: int = CLASSES, rounds: int = 12) -> np.ndarray:
    """A class for each id: k-means, weighted by counts, of the shares of what stands beside it (a row of counts).

    Ids without counts are dealt to the classes in turn.
    """
    out = np.arange(len(counts)) % classes
    seen = np.flatnonzero(counts)
    x = beside[seen].astype(np.float32)
    share = beside[seen].sum(axis=0) / max(1, beside[seen].sum())
    weight = counts[seen].astype(np.float64)
    x += (2 * share).astype(np.float32)
    x /= x.sum(axis=1, keepdims=True)
    np.sqrt(x, out=x)
    order = np.argsort(-weight, kind="stable")
    centre = x[order[:classes]].copy()
    if len(centre) < classes:
        centre = np.concatenate([centre, np.zeros((classes - len(centre), x.shape[1]), np.float32)])
    own = np.zeros(len(seen), np.int64)
    for _ in range(rounds):
        own = (x @ centre.T - 0.5 * (centre * centre).sum(axis=1)).argmax(axis=1)
        mass = np.bincount(own, weight, classes)
        for c in np.flatnonzero(mass).tolist():
            centre[c] = (weight[own == c] @ x[own == c]) / mass[c]
    out[seen] = own
    return out
