"""A small gated recurrent language model in numpy with a class-factored output layer.

A token is one of the head words, the end of a text, or one of a few tail classes that share out all other
words by their last letters. The output is factored: a softmax over classes, then, inside a
class of head words, a softmax over its members. A tail class gives only its own probability;
the words in it are told apart by corpus counts, outside this module.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

TAILS = 16
END = np.uint64(0xFFFFFFFFFFFFFFFF)


def tail_class(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Tail class of a word from its last two bytes."""
    return ((last.astype(np.int64) * 7 + before.astype(np.int64) * 13) % TAILS).astype(np.uint8)


@dataclass
class Gru:
    head: np.ndarray  # sorted hashes of the head words, END included
    symbol: np.ndarray  # head word -> rank by frequency, which is its symbol
    width: int  # head words per class; class c holds the ranks from c * width on
    p: dict[str, np.ndarray]

    @property
    def groups(self) -> int:
        return -(-len(self.head) // self.width)

    @property
    def hidden(self) -> int:
        return self.p["U"].shape[0]

    def symbols(self, hashes: np.ndarray, tails: np.ndarray) -> np.ndarray:
        """Head words by rank, others as the number of head words plus their tail class."""
        at = np.minimum(np.searchsorted(self.head, hashes), len(self.head) - 1)
        return np.where(self.head[at] == hashes, self.symbol[at], len(self.head) + tails.astype(np.int32)).astype(np.int32)

    def classes(self, symbols: np.ndarray) -> np.ndarray:
        n = len(self.head)
        return np.where(symbols < n, symbols // self.width, self.groups + symbols - n)

    def step_table(self) -> np.ndarray:
        """Input part of the gates for every symbol."""
        return self.p["E"] @ self.p["W"] + self.p["b"]

    def advance(self, h: np.ndarray, x: np.ndarray) -> np.ndarray:
        """States after one token each."""
        return _advance(self.p["U"].T, h.T, x.T).T

    def log_probs(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Natural log probability of the next symbol in each state."""
        return self._log_probs(np.hstack([states, np.ones((len(states), 1), states.dtype)]), symbols)

    def _log_probs(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The same for states that end in a one."""
        classes, over_classes, inside = self.classes(symbols), *self.outputs()
        out = np.empty(len(symbols), states.dtype)
        for a in range(0, len(symbols), BLOCK):
            here = slice(a, a + BLOCK)
            out[here] = _log_pick(states[here] @ over_classes, classes[here])
        order, edges, picks = self.by_class(symbols, classes)
        own, found = states[order], np.empty(len(order), out.dtype)
        for c in np.flatnonzero(np.diff(edges)):
            here = slice(edges[c], edges[c + 1])
            found[here] = _log_pick(own[here] @ inside[c], picks[here])
        out[order] += found
        return out

    def outputs(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the classes and of the members of each class, with the biases as the last row."""
        p = self.p
        return np.vstack([p["Wc"], p["bc"]]), np.concatenate([p["Wo"], p["bo"][:, None]], 1)

    def by_class(self, symbols: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of the head words ordered by class, edges of the classes, members they are of their classes)."""
        order = _order(classes)
        edges = np.searchsorted(classes[order], np.arange(self.groups + 1))
        order = order[: edges[-1]]
        return order, edges, symbols[order] - classes[order] * self.width

    def text_scores(self, symbols: np.ndarray, first: np.ndarray, cells: int = 16384) -> np.ndarray:
        """Natural log probability of whole texts; text d owns ``symbols[first[d]:first[d + 1]]``.

        All texts advance together, the longest first, so those still running are a prefix. Tokens are
        laid out step by step. Outputs are computed a window of steps at a time; the state goes on from window to window.
        """
        length = np.diff(first)
        order = np.argsort(-length, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        longest = int(length.max(initial=0))
        alive = len(length) - np.searchsorted(np.sort(length), np.arange(longest), "right")
        base = np.r_[0, np.cumsum(alive)]
        step = np.arange(len(symbols)) - np.repeat(first[:-1], length)
        at = base[step] + np.repeat(place, length)
        laid, owner = np.empty(len(symbols), symbols.dtype), np.empty(len(symbols), np.int64)
        laid[at], owner[at] = symbols, np.repeat(np.arange(len(length)), length)
        table, turned, cut = self.step_table(), np.ascontiguousarray(self.p["U"].T), base.tolist()
        h = np.zeros((self.hidden, len(order)), np.float32)
        out = np.zeros(len(order))
        t = 0
        while t < longest:
            end = max(t + 1, int(np.searchsorted(base, cut[t] + cells, "right")) - 1)
            start = cut[t]
            states = np.ones((cut[end] - start, self.hidden + 1), np.float32)
            for i in range(t, end):
                lo, hi = cut[i], cut[i + 1]
                h = h[:, : hi - lo]
                states[lo - start : hi - start, :-1] = h.T
                h = _advance(turned, h, np.ascontiguousarray(table[laid[lo:hi]].T))
            found = self._log_probs(states, laid[start : cut[end]])
            out += np.bincount(owner[start : cut[end]], found, len(out))
            t = end
        return out


def _advance(turned: np.ndarray, h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """States after one token each; states and inputs are columns."""
    k = len(h)
    u = turned @ h
    gates = _sigmoid(x[: 2 * k] + u[: 2 * k])
    n = gates[k:] * u[2 * k :]
    n += x[2 * k :]
    np.tanh(n, n)
    h = h - n
    h *= gates[:k]
    h += n
    return h


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In the place of ``x``."""
    np.negative(x, x)
    np.exp(x, x)
    x += 1
    return np.reciprocal(x, x)


BLOCK = 2048  # rows whose logits are worked on at a time, so that they stay in the cache
LEAST = 1e-20  # sums of exponentials below this ask for the largest logit of each row


def _exp_sums(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """(exponentials, their sums by row, what was taken off the logits before).

    All rows are lowered by one number; by their own largest logits only if a row would vanish.
    """
    ones = np.ones(logits.shape[1], logits.dtype)
    top = logits.max(initial=-np.inf)
    e = logits - top
    np.exp(e, e)
    sums = e @ ones
    if len(sums) and not sums.min() > LEAST:
        top = logits.max(1, keepdims=True)
        e = np.exp(logits - top)
        sums, top = e @ ones, top[:, 0]
    return e, sums, top


def _log_pick(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    _, sums, top = _exp_sums(logits)
    return logits[np.arange(len(at)), at] - top - np.log(sums)


def _softmax_grad(logits: np.ndarray, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Gradient of the weighted loss by the logits."""
    g, sums, _ = _exp_sums(logits)
    g *= (weight / sums)[:, None]
    g[np.arange(len(at)), at] -= weight
    return g


def _order(values: np.ndarray) -> np.ndarray:
    """Stable order of small numbers; numbers of two bytes are sorted by radix."""
    return np.argsort(values.astype(np.uint16) if values.max(initial=0) < 1 << 16 else values, kind="stable")


def start(
    head: np.ndarray,
    counts: np.ndarray,
    tail_counts: np.ndarray,
    hidden: int = 24,
    embed: int = 24,
    seed: int = 7,
) -> Gru:
    """An untrained model of the head words, the most frequent first, and of the tail classes.

    ``counts`` and ``tail_counts`` say how often each occurs; the output biases start there.
    """
    rng = np.random.default_rng(seed)
    order = np.argsort(head)
    n = len(head)
    width = max(1, int(np.ceil(np.sqrt(n))))
    groups = -(-n // width)
    p = {
        "E": rng.normal(0, 0.1, (n + TAILS, embed)),
        "W": rng.normal(0, embed**-0.5, (embed, 3 * hidden)),
        "b": np.zeros(3 * hidden),
        "U": rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)),
        "Wc": np.zeros((hidden, groups + TAILS)),
        "bc": np.zeros(groups + TAILS),
        "Wo": np.zeros((groups, hidden, width)),
        "bo": np.full((groups, width), -1e4),
    }
    p["bo"].ravel()[:n] = np.log(counts + 0.5)
    p["bc"] += np.log(np.r_[np.bincount(np.arange(n) // width, counts, groups), tail_counts] + 0.5)
    return Gru(head[order], np.arange(n)[order], width, {k: v.astype(np.float32) for k, v in p.items()})


class Trainer:
    """Learns from tokens by truncated backpropagation; works on a copy of the weights."""

    def __init__(self, model: Gru):
        self.model = replace(model, p={k: v.copy() for k, v in model.p.items()})
        self.moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
        self.done = 0

    def learn(self, symbols: np.ndarray, begins: np.ndarray, streams: int, window: int, rate: float) -> None:
        """One pass over consecutive texts; ``begins`` marks their first tokens.

        The tokens are laid out in ``streams`` parallel streams and cut into windows; the state is carried
        from window to window, gradients are not. It starts at zero with every text and stream. The
        last streams are filled up with tokens that count for nothing, so each token counts once.
        """
        if not len(symbols):
            return
        streams = max(1, min(streams, len(symbols) // window))
        steps = -(-len(symbols) // streams)
        fill = steps * streams - len(symbols)
        grid, fresh, live = (
            np.append(x, np.zeros(fill, x.dtype)).reshape(streams, steps).T
            for x in (symbols, begins, np.ones(len(symbols), bool))
        )
        h = np.zeros((streams, self.model.hidden), np.float32)
        for t in range(0, steps, window):
            grads, h = _window_grads(self.model, grid[t : t + window], fresh[t : t + window], h, live[t : t + window])
            self.done += 1
            scale = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            pull = rate * (1 - 0.999**self.done) ** 0.5 / (1 - 0.9**self.done)
            for k, g in grads.items():
                g = g / np.float32(max(1.0, scale))
                a, b = self.moment[k]
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                self.model.p[k] -= (pull * a / (np.sqrt(b) + 1e-8)).astype(np.float32)


def fit(
    hashes: np.ndarray,
    tails: np.ndarray,
    first: np.ndarray,
    head_words: int = 2000,
    hidden: int = 24,
    embed: int = 24,
    streams: int = 64,
    window: int = 32,
    epochs: int = 2,
    rate: float = 0.01,
    seed: int = 7,
) -> Gru:
    """Train in one process on texts given as token hashes (each text ends in END)."""
    kinds, count = np.unique(hashes, return_counts=True)
    top = np.lexsort((kinds, -count))[:head_words]
    if END not in kinds[top]:
        kinds, count = np.append(kinds, END), np.append(count, 0)
        top = np.append(top, len(kinds) - 1)
    rest = np.bincount(tails[~np.isin(hashes, kinds[top])], minlength=TAILS)
    model = start(kinds[top], count[top], rest, hidden, embed, seed)
    begins = np.zeros(len(hashes), bool)
    begins[first[:-1]] = True
    trainer = Trainer(model)
    for epoch in range(epochs):
        trainer.learn(model.symbols(hashes, tails), begins, streams, window, rate / (1 + epoch))
    return trainer.model


def _window_grads(
    m: Gru, symbols: np.ndarray, fresh: np.ndarray, h: np.ndarray, live: np.ndarray | None = None
) -> tuple[dict, np.ndarray]:
    """Gradients of the mean loss over the live tokens of a window (steps x streams), and the state after it.

    The recurrence holds what is known of a token as a column, step by step, so that all its arrays are of one piece.
    """
    p, k = m.p, m.hidden
    steps, streams = symbols.shape
    states, gates, fresh_n, part = (np.empty((steps, w, streams), np.float32) for w in (k, 2 * k, k, k))
    table, restart = m.step_table(), fresh.any(1)
    turned, h = np.ascontiguousarray(p["U"].T), np.ascontiguousarray(h.T)
    for t in range(steps):
        if restart[t]:
            h = h * ~fresh[t]
        states[t] = h
        x, u = np.ascontiguousarray(table[symbols[t]].T), turned @ h
        part[t] = u[2 * k :]
        g = _sigmoid(np.add(x[: 2 * k], u[: 2 * k], gates[t]))
        n = np.multiply(g[k:], part[t], fresh_n[t])
        n += x[2 * k :]
        np.tanh(n, n)
        h = h - n
        h *= g[:k]
        h += n
    g = {name: np.zeros_like(v) for name, v in p.items()}
    flat = np.ones((steps, streams, k + 1), np.float32)
    flat[:, :, :k] = states.transpose(0, 2, 1)
    flat, target = flat.reshape(-1, k + 1), symbols.ravel().astype(np.int64)
    classes = m.classes(target)
    weight = np.ones(target.size) if live is None else live.ravel()
    weight = (weight / weight.sum()).astype(np.float32)
    over_classes, inside = m.outputs()
    out, total = np.empty((len(flat), k), np.float32), np.zeros_like(over_classes)
    for a in range(0, len(flat), BLOCK):
        here = slice(a, a + BLOCK)
        d = _softmax_grad(flat[here] @ over_classes, classes[here], weight[here])
        total += flat[here].T @ d
        np.matmul(d, p["Wc"].T, out[here])
    g["Wc"], g["bc"] = total[:k], total[k]
    order, edges, picks = m.by_class(target, classes)
    own, weight, back = flat[order], weight[order], np.empty((len(order), k), np.float32)
    for c in np.flatnonzero(np.diff(edges)):
        here = slice(edges[c], edges[c + 1])
        d = _softmax_grad(own[here] @ inside[c], picks[here], weight[here])
        total = own[here].T @ d
        g["Wo"][c], g["bo"][c] = total[:k], total[k]
        np.matmul(d, p["Wo"][c].T, back[here])
    out[order] += back
    out = np.ascontiguousarray(out.reshape(steps, streams, k).transpose(0, 2, 1))
    # What the way back multiplies with is known for all steps beforehand.
    z, r, n = gates[:, :k], gates[:, k:], fresh_n
    by_n = (1 - z) * (1 - n * n)
    by_r = part * r * (1 - r)
    by_z = (states - n) * z * (1 - z)
    back = np.zeros((k, streams), np.float32)
    dx, du = (np.empty((steps, 3 * k, streams), np.float32) for _ in range(2))
    for t in reversed(range(steps)):
        dn = np.multiply(back, by_n[t], dx[t, 2 * k :])
        np.multiply(dn, by_r[t], du[t, k : 2 * k])
        np.multiply(back, by_z[t], du[t, :k])
        np.multiply(dn, r[t], du[t, 2 * k :])
        back *= z[t]
        back += p["U"] @ du[t]
        back += out[t]
        if restart[t]:
            back *= ~fresh[t]
    dx[:, : 2 * k] = du[:, : 2 * k]
    g["U"] = (states @ du.transpose(0, 2, 1)).sum(0)
    sums = np.array([np.bincount(target, dx[:, i].ravel(), len(p["E"])) for i in range(3 * k)])  # by symbol
    g["b"], sums = sums.sum(1).astype(dx.dtype), sums.astype(dx.dtype)
    g["W"] = np.ascontiguousarray((sums @ p["E"]).T)
    g["E"] = sums.T @ p["W"].T
    return g, h.T
