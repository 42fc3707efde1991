"""Linear-chain conditional random fields over many sequences at once, in NumPy.

Sequences stand one after another in flat arrays. Exact forward-backward runs in three steps, each vectorised over all
sequences: products of the transfer matrices inside blocks of positions, a scan over each sequence's blocks, and the
messages inside the blocks. A long document so costs a longer scan over its blocks, not a Python step for each word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK = 32


def posteriors(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray, pairwise: bool = False):
    """Marginals (n, k) of every position, log normaliser of every sequence, and the summed pair marginals (k, k).

    scores: (n, k) log potentials of all positions; lengths: positions of each sequence (0 allowed); trans: (k, k).
    """
    n, k = scores.shape
    lengths = np.asarray(lengths, np.int64)
    if not n:
        return np.zeros((0, k)), np.zeros(len(lengths)), np.zeros((k, k))
    top = scores.max(1, keepdims=True)
    e = np.exp(scores - top)
    t = np.exp(trans)
    logz = np.bincount(np.repeat(np.arange(len(lengths)), lengths), top[:, 0], len(lengths))
    blocks = -(-lengths // BLOCK)
    total = int(blocks.sum())
    owner = np.repeat(np.arange(len(lengths)), blocks)
    nth = np.arange(total) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    size = np.minimum(BLOCK, lengths[owner] - nth * BLOCK)
    order = np.argsort(-size, kind="stable")  # at every place the blocks that reach it come first
    owner, nth, size = owner[order], nth[order], size[order]
    start = (np.cumsum(lengths) - lengths)[owner] + nth * BLOCK
    live = [int(np.searchsorted(-size, -j)) for j in range(BLOCK)]  # blocks of more than j places
    at = [start[: live[j]] + j for j in range(BLOCK)]
    by_nth = np.split(o := np.argsort(nth, kind="stable"), np.flatnonzero(np.diff(nth[o])) + 1)

    m = np.zeros((total, k, k))
    m[:] = np.eye(k)
    many = len(by_nth) > 1
    for j in range(BLOCK if many else 0):  # products of the transfer matrices of each block
        c = live[j]
        step = (m[:c].reshape(-1, k) @ t).reshape(c, k, k)
        step *= e[at[j]][:, None]
        if j % 8 == 7:
            step /= step.max((1, 2), keepdims=True)
        m[:c] = step

    # forward: the state before each block, then the messages inside
    before = np.zeros((total, k))
    alpha = np.empty((n, k))
    norm = np.zeros(total)
    state = np.zeros((len(lengths), k))

    def forward(rows: np.ndarray, keep: bool) -> np.ndarray:
        last = np.zeros((len(rows), k))
        for j in range(BLOCK):
            c = int(np.searchsorted(-size[rows], -j))
            if not c:
                break
            p = start[rows[:c]] + j
            new = (before[rows[:c]] if j == 0 else last[:c]) @ t
            if j == 0:
                new[nth[rows[:c]] == 0] = 1
            new *= e[p]
            z = new.sum(1)
            new /= z[:, None]
            last[:c] = new
            if keep:
                alpha[p] = new
                norm[rows[:c]] += np.log(z)
        return last

    if many:
        state[owner[by_nth[0]]] = forward(by_nth[0], False)
        for rows in by_nth[1:]:
            before[rows] = state[owner[rows]]
            new = (before[rows][:, None] @ m[rows])[:, 0]
            state[owner[rows]] = new / new.sum(1, keepdims=True)
    forward(np.arange(total), True)
    logz += np.bincount(owner, norm, len(lengths))

    # backward likewise, from each sequence's last block on
    message = np.ones((total, k))
    state[:] = 1
    for rows in by_nth[:0:-1]:
        message[rows] = state[owner[rows]]
        new = (m[rows] @ message[rows][:, :, None])[:, :, 0]
        state[owner[rows]] = new / new.sum(1, keepdims=True)
    message[by_nth[0]] = state[owner[by_nth[0]]]
    post = alpha
    pair = np.zeros((k, k))
    previous = alpha.copy() if pairwise else None
    for j in range(BLOCK - 1, -1, -1):
        c, p = live[j], at[j]
        beta = message[:c]
        here = beta * e[p]
        if pairwise:
            inner = slice(None) if j else np.flatnonzero(nth[:c] > 0)
            both = (previous[p[inner] - 1])[:, :, None] * t * here[inner][:, None]
            pair += (both / both.sum((1, 2), keepdims=True)).sum(0)
        post[p] *= beta
        new = here @ t.T
        new /= new.sum(1, keepdims=True)
        message[:c] = new
    post /= post.sum(1, keepdims=True)
    return post, logz, pair


@dataclass
class Model:
    """weights: (features, labels); trans: (labels, labels)."""

    weights: np.ndarray
    trans: np.ndarray


def fit(features: list[np.ndarray], values: list[np.ndarray] | None, labels: np.ndarray, lengths: np.ndarray, n_features: int, n_labels: int, items: np.ndarray | None = None, rounds: int = 30, l2: float = 1e-3, rate: float = 0.3, weight: np.ndarray | None = None) -> Model:
    """Maximum conditional likelihood by Adam on the whole sample.

    features, values: of each item, rows padded to one width (feature numbers and their values; values None: 1 each,
    number -1: none). items: the item of each position (None: one each), so equal words share one row.
    weight: of each position in the likelihood of its sequence's labels.
    """
    f = np.asarray(features)
    v = np.where(f >= 0, 1.0 if values is None else np.asarray(values), 0.0)
    f = np.where(f >= 0, f, 0)
    items = np.arange(len(f)) if items is None else items
    n = len(items)
    w, t = np.zeros((n_features, n_labels)), np.zeros((n_labels, n_labels))
    seq = np.repeat(np.arange(len(lengths)), lengths)
    inner = np.r_[False, seq[1:] == seq[:-1]] if n else np.zeros(0, bool)
    gold_pair = np.zeros((n_labels, n_labels))
    np.add.at(gold_pair, (labels[:-1][inner[1:]], labels[1:][inner[1:]]), 1)
    hot = np.eye(n_labels)[labels]
    state = [np.zeros_like(x) for x in (w, t, w, t)]
    for step in range(1, rounds + 1):
        item_scores = np.einsum("ifk,if->ik", w[f], v)
        post, _, pair = posteriors(item_scores[items], lengths, t, pairwise=True)
        diff = hot - post if weight is None else (hot - post) * weight[:, None]
        per_item = np.stack([np.bincount(items, diff[:, c], len(f)) for c in range(n_labels)], 1)
        gw = np.stack([np.bincount(f.ravel(), (v * per_item[:, c, None]).ravel(), n_features) for c in range(n_labels)], 1) / max(1, n) - l2 * w / max(1, n) * 100
        gt = (gold_pair - pair) / max(1, n) - l2 * t
        for k, (x, g) in enumerate(((w, gw), (t, gt))):
            state[k] = 0.9 * state[k] + 0.1 * g
            state[k + 2] = 0.99 * state[k + 2] + 0.01 * g * g
            x += rate * (state[k] / (1 - 0.9**step)) / (np.sqrt(state[k + 2] / (1 - 0.99**step)) + 1e-8)
    return Model(w, t)
