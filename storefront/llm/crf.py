"""A two-label linear-chain conditional random field in numpy.

Label 1 of token t has the score s_t (label 0 has 0); neighbouring labels i, j
have the score T[i, j]. Sequences are given end to end with a flag at each
first token. Forward and backward vectors are products of 2x2 matrices, one per
token; they are computed lane by lane: the tokens are cut into equal lanes, all
lanes step together, and the lanes' own products join them up exactly.
"""

from __future__ import annotations

import numpy as np


def _scan(m00, m01, m10, m11, steps: int) -> np.ndarray:
    """Normalised vectors v_t = M_t v_(t-1) for every t, from v = (1, 0); returns
    the share of the second entry."""
    n = len(m00)
    lanes = -(-n // steps)
    pad = lanes * steps - n

    def lay(x, fill):
        return np.ascontiguousarray(np.concatenate([x, np.full(pad, fill)]).reshape(lanes, steps).T)

    a, b, c, d = lay(m00, 1.0), lay(m01, 0.0), lay(m10, 0.0), lay(m11, 1.0)
    p, q, r, s = np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)
    for t in range(steps):
        p, q, r, s = a[t] * p + b[t] * r, a[t] * q + b[t] * s, c[t] * p + d[t] * r, c[t] * q + d[t] * s
        scale = 1.0 / (p + q + r + s)
        p, q, r, s = p * scale, q * scale, r * scale, s * scale
    x, y = np.empty(lanes), np.empty(lanes)
    u, v = 1.0, 0.0
    for lane, (pp, qq, rr, ss) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist())):
        x[lane], y[lane] = u, v
        u, v = pp * u + qq * v, rr * u + ss * v
        total = u + v
        u, v = u / total, v / total
    out = np.empty((steps, lanes))
    for t in range(steps):
        x, y = a[t] * x + b[t] * y, c[t] * x + d[t] * y
        scale = 1.0 / (x + y)
        x, y = x * scale, y * scale
        out[t] = y
    return out.T.ravel()[:n]


def forward_backward(scores: np.ndarray, first: np.ndarray, trans: np.ndarray):
    """Shares of label 1 in the forward and backward vectors of every token."""
    n = len(scores)
    e = np.exp(np.clip(scores, -30, 30))
    psi = np.exp(np.clip(trans, -15, 15))
    steps = max(1, min(512, int(np.sqrt(n))))
    # Forward: alpha_t(j) = e_t(j) * sum_i alpha(i) psi[i, j]; anew at a first token.
    alpha = _scan(np.where(first, 1.0, psi[0, 0]), np.where(first, 1.0, psi[1, 0]),
                  np.where(first, e, psi[0, 1] * e), np.where(first, e, psi[1, 1] * e), steps)
    # Backward: beta_(t-1)(i) = sum_j psi[i, j] e_t(j) beta_t(j); (1, 1) at a last token.
    follows = np.append(first[1:], True)[::-1]
    nxt = np.append(e[1:], 1.0)[::-1]
    beta = _scan(np.where(follows, 1.0, psi[0, 0]), np.where(follows, 1.0, psi[0, 1] * nxt),
                 np.where(follows, 1.0, psi[1, 0]), np.where(follows, 1.0, psi[1, 1] * nxt), steps)[::-1]
    return alpha, beta


def marginals(scores: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(label 1) of every token."""
    if not len(scores):
        return np.zeros(0)
    alpha, beta = forward_backward(scores, first, trans)
    return alpha * beta / (alpha * beta + (1 - alpha) * (1 - beta))


def train(features: np.ndarray, first: np.ndarray, labels: np.ndarray, dim: int, rounds: int = 40,
          rate: float = 0.5, l2: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights and transitions by AdaGrad on the conditional
    log-likelihood. ``features``: (tokens, kinds) hashed features, the value
    ``dim`` standing for none."""
    w, trans = np.zeros(dim + 1), np.array([[0.0, -3.0], [0.0, -1.0]])
    gw, gt = np.full(dim + 1, 1e-8), np.full((2, 2), 1e-8)
    n, kinds = features.shape
    inner = ~first
    inner[:1] = False
    prev = labels[:-1][inner[1:]].astype(int)
    here = labels[inner].astype(int)
    seen = np.zeros((2, 2))
    np.add.at(seen, (prev, here), 1.0)
    flat = features.ravel()
    positives = max(1.0, labels.sum())
    for _ in range(rounds):
        w[dim] = 0.0
        scores = w[features].sum(axis=1)
        alpha, beta = forward_backward(scores, first, trans)
        p = alpha * beta / (alpha * beta + (1 - alpha) * (1 - beta))
        grad = np.bincount(flat, np.repeat(labels - p, kinds), dim + 1) / positives - l2 * w
        e, psi = np.exp(np.clip(scores[inner], -30, 30)), np.exp(trans)
        a1, b1 = alpha[:-1][inner[1:]], beta[inner]
        joint = np.stack([(1 - a1) * psi[0, 0] * (1 - b1), (1 - a1) * psi[0, 1] * e * b1,
                          a1 * psi[1, 0] * (1 - b1), a1 * psi[1, 1] * e * b1])
        expected = (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
        gradt = (seen - expected) / positives
        gw += grad * grad
        gt += gradt * gradt
        w += rate * grad / np.sqrt(gw)
        trans += 0.3 * gradt / np.sqrt(gt)
    w[dim] = 0.0
    return w, trans
