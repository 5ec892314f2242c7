"""Mini-batch training of networks of one shape side by side, each on rows of its own.

A step of one small network is some eighty calls on arrays of a few kilobytes, whose cost is the calls and the new arrays
rather than the numbers. Here the networks take each step together, into arrays that are made once. Every network goes
through the very operations of ``gradient`` and ``adam_step`` and draws the same random numbers in the same order, so its
state is the one it would have reached alone, to the last bit.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import TYPE_CHECKING

import numpy as np

if TYPE_CHECKING:
    from raritas.operators.autoencoder import NetSpec

# Activations of one step, over all networks that take it together; a task holds some ten arrays of as many bytes times 8.
STACK_NUMBERS = 250_000


def stack_size(spec: NetSpec) -> int:
    """Networks that take a step together."""
    return max(1, STACK_NUMBERS // (spec.batch * sum(spec.layers)))


class _Space:
    """Arrays of a step over ``rows`` rows a network."""

    def __init__(self, spec: NetSpec, count: int, rows: int):
        self.active = [np.empty((count, rows, b)) for b in spec.layers]
        self.back = [np.empty((count, rows, b)) for b in spec.layers]
        self.spare = [np.empty((count, rows, b)) for b in spec.layers]
        self.live = [np.empty((count, rows, b), dtype=bool) for b in spec.layers]
        self.out = np.empty((count, rows, spec.inputs))
        self.shown = self.active
        if spec.dropout:
            self.shown = [np.empty((count, rows, b)) for b in spec.layers]
            self.draws = np.empty((count, rows * sum(spec.layers)))
            self.keep = np.empty(self.draws.shape, dtype=bool)
            ends = np.cumsum([rows * b for b in spec.layers])[:-1]
            self.masks = [part.reshape(count, rows, b) for part, b in zip(np.split(self.draws, ends, axis=1), spec.layers)]


class Lockstep:
    """Networks of one shape from their ``states`` on, one line each of weights, both moments and the number of steps."""

    def __init__(self, spec: NetSpec, states: Sequence[np.ndarray]):
        table = np.stack(states)
        self.spec, self.count = spec, len(table)
        self.flat, self.first, self.second = (np.array(part) for part in np.split(table[:, :-1], 3, axis=1))
        self.steps = table[:, -1].tolist()
        self.slope, self.spare, self.change, self.twice = (np.empty_like(self.flat) for _ in range(4))
        self.spaces: dict[int, _Space] = {}
        self.layers, self.slopes, self.doubled = self._parts(self.flat), self._parts(self.slope), self._parts(self.twice)

    def _parts(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Views of the weights and biases of each layer."""
        parts, at = [], 0
        for a, b in zip(self.spec.widths, self.spec.widths[1:]):
            end = at + a * b
            parts.append((flat[:, at:end].reshape(self.count, a, b), flat[:, end : end + b]))
            at = end + b
        return parts

    def states(self) -> list[np.ndarray]:
        return [np.concatenate([*parts, [step]]) for *parts, step in zip(self.flat, self.first, self.second, self.steps)]

    def epoch(self, x: Sequence[np.ndarray], rngs: Sequence[np.random.Generator]) -> None:
        """One pass over the rows of each network, as many for all, in the order its generator gives."""
        dealt = np.stack([rows[rng.permutation(len(rows))] for rows, rng in zip(x, rngs)])
        for start in range(0, dealt.shape[1], self.spec.batch):
            batch = dealt[:, start : start + self.spec.batch]
            space = self.spaces.get(batch.shape[1])
            if space is None:
                space = self.spaces[batch.shape[1]] = _Space(self.spec, self.count, batch.shape[1])
            self._gradients(batch, space, rngs)
            self._adam()

    def _gradients(self, x: np.ndarray, space: _Space, rngs: Sequence[np.random.Generator]) -> None:
        spec, rows, layers = self.spec, x.shape[1], self.layers
        if spec.dropout:
            for draws, rng in zip(space.draws, rngs):
                rng.random(out=draws)
            np.greater_equal(space.draws, spec.dropout, out=space.keep)
            np.multiply(space.keep, 1.0 / (1.0 - spec.dropout), out=space.draws)
        tanh = spec.activation == "tanh"
        if tanh:
            np.multiply(self.flat, 2.0, out=self.twice)  # exact, and so are sums of products by it
        h = x
        for (w, b), a, shown, i in zip(self.doubled if tanh else layers, space.active, space.shown, range(len(spec.layers))):
            _product(h, w, a)
            a += b[:, None]
            if tanh:
                np.exp(a, out=a)
                a += 1.0
                np.divide(2.0, a, out=a)
                np.subtract(1.0, a, out=a)
            else:
                np.maximum(a, 0.0, out=a)
            if spec.dropout:
                np.multiply(a, space.masks[i], out=shown)
            h = shown
        w, b = layers[-1]
        out = _product(h, w, space.out)
        out += b[:, None]
        if spec.output == "sigmoid":
            np.minimum(np.maximum(out, -500, out=out), 500, out=out)
            np.negative(out, out=out)
            np.exp(out, out=out)
            out += 1.0
            np.divide(1.0, out, out=out)
        delta = 2.0 * (out - x) / (rows * x.shape[2]) + 2.0 * spec.activity_l2 * out / rows
        if spec.output == "sigmoid":
            delta = delta * out * (1.0 - out)
        for i in range(len(layers) - 1, -1, -1):
            source = space.shown[i - 1] if i else x
            np.matmul(source.transpose(0, 2, 1), delta, out=self.slopes[i][0])
            np.add.reduce(delta, axis=1, out=self.slopes[i][1])
            if i:
                a, back, spare = space.active[i - 1], space.back[i - 1], space.spare[i - 1]
                _product(delta, layers[i][0].transpose(0, 2, 1), back)
                if spec.dropout:
                    back *= space.masks[i - 1]
                _penalty(a, 2.0 * spec.activity_l2, rows, spare)
                back += spare
                if tanh:
                    np.multiply(a, a, out=spare)
                    np.subtract(1.0, spare, out=spare)
                    back *= spare
                else:
                    back *= np.greater(a, 0.0, out=space.live[i - 1])
                delta = back

    def _adam(self) -> None:
        self.steps = [step + 1 for step in self.steps]
        spec, spare, change = self.spec, self.spare, self.change
        self.first *= 0.9
        np.multiply(self.slope, 0.1, out=spare)
        self.first += spare
        self.second *= 0.999
        np.multiply(self.slope, 0.001, out=spare)
        spare *= self.slope
        self.second += spare
        rates = [spec.learning_rate * math.sqrt(1.0 - 0.999**step) / (1.0 - 0.9**step) for step in self.steps]
        np.multiply(self.first, np.array(rates)[:, None], out=change)
        np.sqrt(self.second, out=spare)
        spare += 1e-7
        change /= spare
        self.flat -= change


def _product(a: np.ndarray, w: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Matrix products, without the library's for a single inner number."""
    return np.multiply(a, w, out=out) if a.shape[2] == 1 else np.matmul(a, w, out=out)


def _penalty(a: np.ndarray, factor: float, rows: int, out: np.ndarray) -> None:
    if rows & (rows - 1):
        np.multiply(a, factor, out=out)
        out /= rows
    else:
        np.multiply(a, factor / rows, out=out)  # the same number: a power of 2 divides without rounding
