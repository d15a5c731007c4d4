"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation through time.

A slot is what the model predicts: a frequent word, a bucket of all other words, or the end of a text. Slot s belongs to
class s // MEMBERS; its probability is that of the class times that within the class, both from the state. Many documents
are laid end to end on parallel streams; the state is reset where a document starts and carried from window to window.
"""

from __future__ import annotations

import heapq

import numpy as np

HIDDEN, CLASSES, MEMBERS = 16, 32, 32
SLOTS = CLASSES * MEMBERS
SHAPES = {"table": (SLOTS, 3 * HIDDEN), "recur": (HIDDEN, 3 * HIDDEN), "to_class": (HIDDEN, CLASSES),
          "class_bias": (CLASSES,), "to_member": (CLASSES, HIDDEN, MEMBERS), "member_bias": (CLASSES, MEMBERS)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())
TRAIN_STREAMS, TRAIN_STEPS = 512, 16
# Training documents are cut here; in scoring they stay whole.
TRAIN_PIECE = 1024
SCORE_STREAMS, SCORE_STEPS = 512, 32
RATE, CLIP = 0.008, 1.0


class Model:
    """Named views of one flat vector of parameters."""

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in SHAPES.items():
            size = int(np.prod(shape))
            setattr(self, name, flat[at:at + size].reshape(shape))
            at += size

    @classmethod
    def start(cls, slot_counts: np.ndarray, seed: int = 7) -> Model:
        """Small random weights, and biases that give each slot its share of ``slot_counts``."""
        draw = np.random.default_rng(seed)
        model = cls(draw.normal(0, 0.1, SIZE).astype(np.float32))
        mass = (slot_counts.astype(np.float64) + 0.5).reshape(CLASSES, MEMBERS)
        model.class_bias[:] = np.log(mass.sum(axis=1) / mass.sum())
        model.member_bias[:] = np.log(mass / mass.sum(axis=1, keepdims=True))
        return model


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _recur(model: Model, inputs: np.ndarray, first: np.ndarray, state: np.ndarray, kept: list | None) -> np.ndarray:
    """States after each step (steps, streams, HIDDEN); ``kept`` gets what backpropagation needs."""
    steps, n = inputs.shape
    out = np.empty((steps, n, HIDDEN), np.float32)
    given = model.table[inputs]
    kept_state = (~first)[:, :, None].astype(np.float32)
    for t in range(steps):
        before = state * kept_state[t]
        own = before @ model.recur
        gates = _sigmoid(given[t, :, :2 * HIDDEN] + own[:, :2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        new = np.tanh(given[t, :, 2 * HIDDEN:] + r * own[:, 2 * HIDDEN:])
        state = new + z * (before - new)
        out[t] = state
        if kept is not None:
            kept.append((before, z, r, new, own[:, 2 * HIDDEN:]))
    return out


def _softmax_loss(logits: np.ndarray, target: np.ndarray, want_slope: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Log probability of each column's target; the slope of its negative by the logits (choices, columns)."""
    logits -= logits.max(axis=0)
    columns = np.arange(len(target))
    hit = logits[target, columns]
    np.exp(logits, out=logits)
    total = logits.sum(axis=0)
    found = hit - np.log(total)
    if not want_slope:
        return found, None
    logits /= total
    logits[target, columns] -= 1
    return found, logits


def _predict(model: Model, states: np.ndarray, targets: np.ndarray, slope: Model | None):
    """Log probability (natural) of each target from its state; with ``slope``, also the slope by the states."""
    order = np.argsort(targets // MEMBERS, kind="stable")  # tokens of a class stand together
    states, targets = states[order], targets[order]
    kind, member = targets // MEMBERS, targets % MEMBERS
    logits = model.to_class.T @ states.T
    logits += model.class_bias[:, None]
    found, by_class = _softmax_loss(logits, kind, slope is not None)
    back = None
    if slope is not None:
        slope.to_class += (by_class @ states).T
        slope.class_bias += by_class.sum(axis=1)
        back = by_class.T @ model.to_class.T
    bounds = np.searchsorted(kind, np.arange(CLASSES + 1))
    for c in np.flatnonzero(np.diff(bounds)):
        here = slice(bounds[c], bounds[c + 1])
        own = states[here]
        logits = model.to_member[c].T @ own.T
        logits += model.member_bias[c][:, None]
        log_p, by_member = _softmax_loss(logits, member[here], slope is not None)
        found[here] += log_p
        if slope is not None:
            slope.to_member[c] += (by_member @ own).T
            slope.member_bias[c] += by_member.sum(axis=1)
            back[here] += by_member.T @ model.to_member[c].T
    out = np.empty_like(found)
    out[order] = found
    if back is not None:
        by_state = np.empty_like(back)
        by_state[order] = back
        back = by_state
    return out, back


class Streams:
    """Documents (slot numbers, each with its end) laid on parallel streams, the longest stream first."""

    def __init__(self, slots: np.ndarray, bounds: np.ndarray, end: int, n: int):
        sizes = np.diff(bounds)
        load = [(0, k) for k in range(min(n, len(sizes)))]
        member: list[list[int]] = [[] for _ in load]
        for doc in np.argsort(-sizes, kind="stable").tolist():
            size, k = heapq.heappop(load)
            member[k].append(doc)
            heapq.heappush(load, (size + int(sizes[doc]), k))
        length = {k: size for size, k in load}
        ranked = sorted(length, key=lambda k: -length[k])
        docs = np.array([d for k in ranked for d in member[k]], np.int64)
        self.length = np.array([length[k] for k in ranked], np.int64)
        self.start = np.cumsum(self.length) - self.length
        at = np.repeat(bounds[docs] - (np.cumsum(sizes[docs]) - sizes[docs]), sizes[docs]) + np.arange(sizes.sum())
        at = at.astype(np.int32)
        self.place = at  # of each stream position in ``slots``
        self.target = slots[at]
        self.first = np.isin(at, bounds[:-1])
        self.input = np.where(self.first, end, np.concatenate([[end], self.target[:-1]]) if len(at) else self.target)

    def windows(self, steps: int):
        """Positions (steps, streams still running) of each window and which of them are real."""
        for t in range(0, int(self.length.max(initial=0)), steps):
            n = int(np.searchsorted(-self.length, -t, "left"))
            offset = t + np.arange(steps)[:, None]
            real = offset < self.length[:n]
            yield np.where(real, self.start[:n] + offset, self.start[:n]), real


def score(model: Model, slots: np.ndarray, bounds: np.ndarray, end: int) -> np.ndarray:
    """Natural log probability of each token; documents are ``slots[bounds[i]:bounds[i + 1]]``."""
    streams = Streams(slots, bounds, end, SCORE_STREAMS)
    out = np.zeros(len(slots), np.float64)
    state = np.zeros((len(streams.length), HIDDEN), np.float32)
    for at, real in streams.windows(SCORE_STEPS):
        states = _recur(model, streams.input[at], streams.first[at], state[:at.shape[1]], None)
        state = states[-1]
        out[streams.place[at[real]]] = _predict(model, states[real], streams.target[at[real]], None)[0]
    return out


class Learner:
    """Adam steps over windows of documents."""

    def __init__(self, flat: np.ndarray):
        self.model, self.tokens, self.steps = Model(flat.astype(np.float32).copy()), 0, 0
        self.mean, self.square = np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32)

    def learn(self, slots: np.ndarray, bounds: np.ndarray, end: int) -> float:
        """One pass; returns the summed log probability before each step."""
        cuts = [np.arange(a, b, TRAIN_PIECE) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        streams, total = Streams(slots, np.concatenate([*cuts, bounds[-1:]]), end, TRAIN_STREAMS), 0.0
        state = np.zeros((len(streams.length), HIDDEN), np.float32)
        for at, real in streams.windows(TRAIN_STEPS):
            n = at.shape[1]
            inputs, first, kept = streams.input[at], streams.first[at], []
            states = _recur(self.model, inputs, first, state[:n], kept)
            state = states[-1]
            slope = Model(np.zeros(SIZE, np.float32))
            found, back = _predict(self.model, states[real], streams.target[at[real]], slope)
            total += float(found.sum())
            by_state = np.zeros_like(states)
            by_state[real] = back
            self._backward(slope, by_state, inputs, first, kept)
            self._step(slope.flat / len(found))
            self.tokens += len(found)
        return total

    def _backward(self, slope: Model, by_state: np.ndarray, inputs: np.ndarray, first: np.ndarray, kept: list) -> None:
        steps, n = inputs.shape
        by_gates, by_given = np.empty((2, steps, n, 3 * HIDDEN), np.float32)
        later = np.zeros((n, HIDDEN), np.float32)
        kept_state = (~first)[:, :, None].astype(np.float32)
        for t in reversed(range(steps)):
            before, z, r, new, own = kept[t]
            here = by_state[t] + later
            by_new = here * (1 - z) * (1 - new * new)
            by_given[t, :, :HIDDEN] = here * (before - new) * z * (1 - z)
            by_given[t, :, HIDDEN:2 * HIDDEN] = by_new * own * r * (1 - r)
            by_given[t, :, 2 * HIDDEN:] = by_new
            by_gates[t] = by_given[t]
            by_gates[t, :, 2 * HIDDEN:] *= r
            later = (here * z + by_gates[t] @ self.model.recur.T) * kept_state[t]
        slope.recur += np.stack([k[0] for k in kept]).reshape(-1, HIDDEN).T @ by_gates.reshape(-1, 3 * HIDDEN)
        flat = inputs.ravel()
        order = np.argsort(flat, kind="stable")
        begin = np.flatnonzero(np.diff(flat[order], prepend=-1))
        slope.table[flat[order][begin]] += np.add.reduceat(by_given.reshape(-1, 3 * HIDDEN)[order], begin, axis=0)

    def _step(self, slope: np.ndarray) -> None:
        self.steps += 1
        norm = float(np.sqrt(np.dot(slope, slope)))
        if norm > CLIP:
            slope *= CLIP / norm
        self.mean += 0.1 * (slope - self.mean)
        self.square += 0.005 * (slope * slope - self.square)
        scale = RATE * np.sqrt(1 - 0.995 ** self.steps) / (1 - 0.9 ** self.steps)
        self.model.flat -= np.float32(scale) * self.mean / (np.sqrt(self.square) + np.float32(1e-8))
