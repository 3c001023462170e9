"""A bidirectional gated recurrent network over bytes, in numpy.

Two directions of H units read segments of SEGMENT bytes; at every position a
softmax over both states gives the label's probabilities. Training is
backpropagation through time with Adam; inference steps many segments at once.
"""

from __future__ import annotations

import numpy as np

PAD = 256
SEGMENT = 64
HIDDEN = 8
GATES = ("z", "r", "n")


def new_network(labels: int, hidden: int, seed: int) -> dict[str, np.ndarray]:
    rng, p = np.random.default_rng(seed), {}
    for d in ("f", "b"):
        for g in GATES:
            p[f"{d}W{g}"] = rng.normal(0, 0.3, (PAD + 1, hidden)).astype(np.float32)
            p[f"{d}U{g}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, hidden)).astype(np.float32)
        p[f"{d}O"] = rng.normal(0, 0.3, (hidden, labels)).astype(np.float32)
    p["o"] = np.zeros(labels, np.float32)
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def states(p: dict, d: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (time, segments, hidden) of direction ``d`` over bytes ``x``
    (time, segments). Padding keeps the state at zero before a text begins."""
    steps, n = x.shape
    hidden = p["fUz"].shape[0]
    out = np.empty((steps, n, hidden), np.float32)
    h = np.zeros((n, hidden), np.float32)
    valid = (x != PAD)
    for t in (range(steps) if d == "f" else range(steps - 1, -1, -1)):
        at = x[t]
        z = p[d + "Wz"].take(at, 0)
        z += h @ p[d + "Uz"]
        z = _sigmoid(z)
        r = p[d + "Wr"].take(at, 0)
        r += h @ p[d + "Ur"]
        r = _sigmoid(r)
        q = h @ p[d + "Un"]
        c = r * q
        c += p[d + "Wn"].take(at, 0)
        np.tanh(c, out=c)
        if keep is not None:
            keep.append((t, h, z, r, c, q))
        h = h - c
        h *= z
        h += c
        if not valid[t].all():
            h *= valid[t][:, None]
        out[t] = h
    return out


def log_probabilities(p: dict, x: np.ndarray) -> np.ndarray:
    """(time, segments, labels) log-probabilities of every position."""
    y = states(p, "f", x) @ p["fO"] + states(p, "b", x) @ p["bO"] + p["o"]
    y -= y.max(axis=2, keepdims=True)
    y -= np.log(np.exp(y).sum(axis=2, keepdims=True))
    return y


def loss_gradients(p: dict, x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy over weighted positions and its gradients by
    backpropagation through time. ``target``: label of each segment."""
    tape = {"f": [], "b": []}
    h = {d: states(p, d, x, tape[d]) for d in tape}
    y = h["f"] @ p["fO"] + h["b"] @ p["bO"] + p["o"]
    y -= y.max(axis=2, keepdims=True)
    prob = np.exp(y)
    prob /= prob.sum(axis=2, keepdims=True)
    total = max(1.0, float(weight.sum()))
    seg = np.arange(x.shape[1])
    loss = -float((weight * np.log(np.maximum(prob[:, seg, target], 1e-9))).sum()) / total
    dy = prob
    dy[:, seg, target] -= 1.0
    dy *= (weight / total)[:, :, None].astype(np.float32)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["o"] = dy.sum(axis=(0, 1))
    valid = (x != PAD).astype(np.float32)
    for d in ("f", "b"):
        g[d + "O"] = np.einsum("tsh,tsl->hl", h[d], dy)
        dout = dy @ p[d + "O"].T
        dh = np.zeros_like(h[d][0])
        for t, before, z, r, c, q in reversed(tape[d]):
            dh = (dh + dout[t]) * valid[t][:, None]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (before - c) * z * (1 - z)
            dr = dc * q * r * (1 - r)
            dq = dc * r
            for gate, da in (("z", dz), ("r", dr), ("n", dc)):
                np.add.at(g[f"{d}W{gate}"], x[t], da)
            g[d + "Uz"] += before.T @ dz
            g[d + "Ur"] += before.T @ dr
            g[d + "Un"] += before.T @ dq
            dh = dh * z + dz @ p[d + "Uz"].T + dr @ p[d + "Ur"].T + dq @ p[d + "Un"].T
    return loss, g


def segments_of(text: bytes) -> np.ndarray:
    """(segments, SEGMENT) bytes of a text, the last one padded."""
    n = max(1, -(-len(text) // SEGMENT))
    out = np.full(n * SEGMENT, PAD, np.int16)
    out[:len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, SEGMENT)


#: Bytes that can be part of a letter: only their positions count.
LETTER_BYTES = np.array([chr(i).isalpha() and i < 128 or 128 <= i < 256 for i in range(257)])


def train(texts: list[bytes], labels: list[int], classes: int, rounds: int = 500, batch: int = 96,
          rate: float = 0.02, seed: int = 3, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    """Adam over random segments, labels drawn evenly."""
    rng, p = np.random.default_rng(seed), new_network(classes, hidden, seed)
    own = [np.concatenate([segments_of(t) for t, y in zip(texts, labels) if y == c and t]) for c in range(classes)]
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    for i in range(1, rounds + 1):
        target = rng.integers(0, classes, batch)
        x = np.stack([own[c][rng.integers(0, len(own[c]))] for c in target]).T
        _, g = loss_gradients(p, x, target, LETTER_BYTES[x].astype(np.float64))
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        lr = rate * min(1.0, 2.0 - 2.0 * i / (rounds + 1)) * np.sqrt(1 - 0.999 ** i) / (1 - 0.9 ** i)
        for k, a in g.items():
            a = a * min(1.0, 1.0 / max(norm, 1e-9))
            m[k] += 0.1 * (a - m[k])
            v[k] += 0.001 * (a * a - v[k])
            p[k] -= (lr * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
    return p


def document_log_probabilities(p: dict, texts: list[bytes], block: int = 2048) -> np.ndarray:
    """(texts, labels): mean log-probabilities over each text's letter positions."""
    segs = [segments_of(t) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(s) for s in segs])
    x = np.concatenate(segs)
    total, count = np.zeros((len(texts), len(p["o"]))), np.zeros(len(texts))
    for i in range(0, len(x), block):
        part = np.ascontiguousarray(x[i:i + block].T)
        weight = LETTER_BYTES[part].astype(np.float32)
        y = np.einsum("tsl,ts->sl", log_probabilities(p, part), weight)
        np.add.at(total, owner[i:i + block], y)
        np.add.at(count, owner[i:i + block], weight.sum(axis=0))
    return total / np.maximum(1.0, count)[:, None]
