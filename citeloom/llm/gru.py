"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax.

A token is an end (class 0), one of the frequent head words (classes of equal size, each with its own
softmax), or a tail word. Tail words form classes by their last two bytes; inside such a class the
corpus counts give the probability, so every word of any vocabulary has one. The biases start at the
corpus's own frequencies, that is at the unigram model.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

HIDDEN = 16
HEAD = 1024
SIZE = 32  # head words in a class
TAILS = 32
LANES, STEPS = 256, 16
LONGER = 16  # how many times as long a window may be when few lanes are left
F32 = np.float32


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAILS


@dataclass
class Vocabulary:
    """Head words by frequency with their counts, documents (ends), and the mass of each tail class."""

    head: list[bytes]
    head_counts: np.ndarray
    ends: int
    tail_mass: np.ndarray  # sum of c + 0.5 over a class's tail words, plus 0.5 for an unseen word

    def __post_init__(self):
        self.ids = {w: i for i, w in enumerate(self.head)}
        self.n_head = -(-len(self.head) // SIZE)
        self.n_classes = 1 + self.n_head + TAILS
        self.n_inputs = 1 + len(self.head) + TAILS

    def code(self, word: bytes) -> int:
        """0 for the end, 1 + i for head word i, then the tail classes."""
        i = self.ids.get(word, -1)
        return 1 + i if i >= 0 else 1 + len(self.head) + tail_class(word)

    def split(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each code and, for head words, the index of the word, else -1."""
        h = len(self.head)
        head = (codes > 0) & (codes <= h)
        cls = np.where(codes == 0, 0, np.where(head, 1 + (codes - 1) // SIZE, codes - h + self.n_head))
        return cls, np.where(head, codes - 1, -1)


def initial(v: Vocabulary, hidden: int = HIDDEN, seed: int = 3) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    mass = np.zeros(v.n_classes)
    mass[0] = v.ends + 0.5
    counts = np.append(v.head_counts + 0.5, np.zeros(v.n_head * SIZE - len(v.head)))
    mass[1 : 1 + v.n_head] = counts.reshape(v.n_head, SIZE).sum(1) if v.n_head else []
    mass[1 + v.n_head :] = v.tail_mass
    with np.errstate(divide="ignore"):
        inner = np.maximum(np.log(counts), -30.0)  # places without a word
    return {
        "x": r.normal(0, 0.3, (v.n_inputs, 3 * hidden)).astype(F32),
        "u": r.normal(0, 0.3 / np.sqrt(hidden) * 2, (hidden, 3 * hidden)).astype(F32),
        "a": r.normal(0, 0.02, (hidden, v.n_classes)).astype(F32),
        "ab": np.log(mass / mass.sum()).astype(F32),
        "w": r.normal(0, 0.02, (v.n_head * SIZE, hidden)).astype(F32),
        "wb": inner.astype(F32),
    }


def _by_gate(m: np.ndarray, n: int) -> np.ndarray:
    """Columns of update, reset and new value as three matrices."""
    return np.ascontiguousarray(m.reshape(-1, 3, n).transpose(1, 0, 2))


def forward(p: dict, h: np.ndarray, inputs: np.ndarray, fresh: np.ndarray, keep: bool):
    """Run a window (steps x lanes) from state ``h``. Returns the states before each input, the last
    state and, for backpropagation, update, reset and new value of each step and its recurrent part."""
    steps, lanes = inputs.shape
    n = h.shape[1]
    gates, u = np.empty((3, steps, lanes, n), h.dtype), _by_gate(p["u"], n)
    for k, x in enumerate(_by_gate(p["x"], n)):
        np.take(x, inputs, axis=0, out=gates[k], mode="clip")
    states = np.empty((steps, lanes, n), h.dtype)
    back = np.empty_like(states) if keep else None
    begins = fresh.any(1)
    for t in range(steps):
        if begins[t]:
            h = np.where(fresh[t][:, None], h.dtype.type(0), h)
        states[t] = h
        zr, v = gates[:2, t], gates[2, t]
        zr[0] += h @ u[0]
        zr[1] += h @ u[1]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        part = h @ u[2]
        if keep:
            back[t] = part
        part *= zr[1]
        v += part
        np.tanh(v, out=v)
        h = h - v
        h *= zr[0]
        h += v
    return states, h, (gates, back)


def _softmax(logits: np.ndarray, target: np.ndarray, safe: bool, grad: bool) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each row's target and, with ``grad``, the gradient of its negative, in place of ``logits``."""
    if not safe:
        np.clip(logits, -60, 60, out=logits)
    at = np.arange(0, logits.size, logits.shape[1]) + target
    flat = logits.reshape(-1)
    score = flat[at]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    score -= np.log(total)
    if grad:
        logits *= np.reciprocal(total)[:, None]
        flat[at] -= 1
    return score, logits


def outputs(p: dict, states: np.ndarray, cls: np.ndarray, word: np.ndarray, grad: bool):
    """Log probability (natural) of each target; with ``grad`` also the gradients of its negative.

    A state gets a 1 at its end, so that biases are a row of the weights. Rows with a head word are put
    in the order of their classes, so that each class is one product."""
    n = states.shape[1]
    of_class, of_word = np.concatenate([p["a"], p["ab"][None]]), np.concatenate([p["w"], p["wb"][:, None]], 1)
    one = np.ones((len(states), n + 1), states.dtype)
    one[:, :n] = states
    # States are within -1 and 1: logits this small can be raised as they are.
    safe = max(np.abs(of_class).sum(0).max(), np.abs(of_word).sum(1).max(initial=0)) < 80
    score, d = _softmax(one @ of_class, cls, safe, grad)
    g: dict[str, np.ndarray] = {}
    dh = None
    if grad:
        ga = one.T @ d
        g["a"], g["ab"], dh = ga[:n], ga[n], d @ p["a"].T
        gw = np.zeros_like(of_word)
    at = np.flatnonzero(word >= 0)
    if len(at):
        at = at[np.argsort((word[at] // SIZE).astype(np.uint16), kind="stable")]
        group = word[at] // SIZE
        begin = np.append(True, group[1:] != group[:-1])
        cuts = [*np.flatnonzero(begin).tolist(), len(at)]
        spans = list(zip(group[begin].tolist(), cuts, cuts[1:], strict=False))
        s, by_class = one[at], of_word.reshape(-1, SIZE, n + 1)
        inner = np.empty((len(at), SIZE), s.dtype)
        for k, a, b in spans:
            np.matmul(s[a:b], by_class[k].T, out=inner[a:b])
        more, d = _softmax(inner, word[at] - group * SIZE, safe, grad)
        score[at] += more
        if grad:
            into, w, below = gw.reshape(by_class.shape), p["w"].reshape(-1, SIZE, n), np.empty((len(at), n), s.dtype)
            for k, a, b in spans:
                np.matmul(d[a:b].T, s[a:b], out=into[k])
                np.matmul(d[a:b], w[k], out=below[a:b])
            dh[at] += below
    if grad:
        g["w"], g["wb"] = gw[:, :n], gw[:, n]
    return (score, g, dh) if grad else score


def backward(p: dict, g: dict, states, kept, inputs, fresh, dout) -> None:
    """Backpropagation through the window's steps; the state it began with is taken as given."""
    steps, lanes, n = states.shape
    (z, r, new), back = kept
    slope = np.empty((4, *states.shape), states.dtype)  # of update, reset, recurrent part and new value by the state after
    keep = 1 - z
    np.multiply(keep, 1 - new * new, out=slope[3])
    np.multiply(slope[3], r, out=slope[2])
    np.multiply(slope[2], back, out=slope[1])
    slope[1] *= 1 - r
    np.subtract(states, new, out=slope[0])
    slope[0] *= z
    slope[0] *= keep
    parts = np.ascontiguousarray(_by_gate(p["u"], n).transpose(0, 2, 1))
    carry = np.zeros((lanes, n), states.dtype)
    begins = fresh.any(1)
    for t in range(steps - 1, -1, -1):
        d = slope[:, t]
        d *= carry
        carry *= z[t]
        for k in range(3):
            carry += d[k] @ parts[k]
        carry += dout[t]
        if begins[t]:
            carry[fresh[t]] = 0
    flat, by_gate, h = inputs.ravel(), slope.reshape(4, -1, n), states.reshape(-1, n)
    g["u"] = np.concatenate([h.T @ by_gate[k] for k in range(3)], 1)
    order = np.argsort(flat.astype(np.uint16), kind="stable")  # a radix sort; HEAD + TAILS codes
    ranked = flat[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    g["x"] = np.zeros_like(p["x"])
    g["x"][ranked[first]] = np.concatenate([np.add.reduceat(by_gate[k][order], first) for k in (0, 1, 3)], 1)


class Adam:
    def __init__(self, p: dict, rate: float = 0.01):
        self.rate, self.t = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, p: dict, g: dict, scale: float, share: float = 1.0) -> None:
        """One update; ``share`` of the rate."""
        self.t += 1
        size = np.sqrt(sum(float((x * x).sum()) for x in g.values())) * scale
        scale *= min(1.0, 1.0 / max(size, 1e-9))
        rate = self.rate * share * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, x in g.items():
            x = x * F32(scale)
            self.m[k] += F32(0.1) * (x - self.m[k])
            self.v[k] += F32(0.001) * (x * x - self.v[k])
            p[k] -= F32(rate) * self.m[k] / (np.sqrt(self.v[k]) + F32(1e-8))


def lanes_of(docs: list[np.ndarray], lanes: int = LANES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents (codes, each with its end) packed into lanes, long ones first: steps x lanes of codes
    (-1: nothing), of document numbers, and of whether the state begins anew."""
    lanes = max(1, min(lanes, len(docs)))
    heap, rows = [(0, i) for i in range(lanes)], [[] for _ in range(lanes)]
    for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
        size, i = heap[0]
        rows[i].append(d)
        heapq.heapreplace(heap, (size + len(docs[d]), i))
    steps = max(size for size, _ in heap)
    codes, owner, fresh = np.full((steps, lanes), -1, np.int32), np.zeros((steps, lanes), np.int32), np.zeros((steps, lanes), bool)
    for i, row in enumerate(rows):
        at = 0
        for d in row:
            n = len(docs[d])
            codes[at : at + n, i], owner[at : at + n, i], fresh[at, i] = docs[d], d, True
            at += n
    return codes, owner, fresh


def windows(codes: np.ndarray, steps: int = STEPS) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(steps, lanes still running, their codes) of each window; a lane that has ended never runs again.

    Where few lanes are left (the ends of very long documents) a window has more steps, so that it
    still has enough tokens to be worth its fixed cost."""
    at, lanes = 0, np.arange(codes.shape[1])
    while at < len(codes):
        lanes = lanes[codes[at, lanes] >= 0]
        to = at + steps * max(1, min(LONGER, codes.shape[1] // len(lanes)))
        yield slice(at, to), lanes, codes[at:to, lanes]
        at = to


def learn(p: dict, v: Vocabulary, docs: list[np.ndarray], rate: float = 0.01, lanes: int = LANES, opt: Adam | None = None) -> Adam:
    """One pass of truncated backpropagation over the documents; the state is carried across windows.

    A window with few lanes left has few tokens, and its step is as much smaller."""
    opt = opt or Adam(p, rate)
    codes, _, fresh = lanes_of(docs, lanes)
    h = np.zeros((codes.shape[1], p["u"].shape[0]), F32)
    for at, running, part in windows(codes):
        live = part >= 0
        inputs = np.maximum(part, 0)
        begin = fresh[at, running]
        states, h[running], kept = forward(p, h[running], inputs, begin, True)
        cls, word = v.split(part[live])
        _, g, dh = outputs(p, states[live], cls, word, True)
        dout = np.zeros_like(states)
        dout[live] = dh
        backward(p, g, states, kept, inputs, begin, dout)
        opt.step(p, g, 1.0 / live.sum(), min(1.0, live.sum() / (STEPS * codes.shape[1])))
    return opt


def log_likelihood(p: dict, v: Vocabulary, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each document's classes and head words, ends included."""
    total = np.zeros(len(docs))
    if not docs:
        return total
    codes, owner, fresh = lanes_of(docs)
    h = np.zeros((codes.shape[1], p["u"].shape[0]), F32)
    for at, running, part in windows(codes, 4 * STEPS):
        live = part >= 0
        states, h[running], _ = forward(p, h[running], np.maximum(part, 0), fresh[at, running], False)
        cls, word = v.split(part[live])
        total += np.bincount(owner[at, running][live], outputs(p, states[live], cls, word, False), len(docs))
    return total
