"""The 32-bit xorshift generator with skip-ahead: any draw of its one sequence can be reached without those before it.

A step is linear over bits, so k steps are the k-th power of a 32 x 32 bit matrix, which squaring gives in a few products. A matrix is kept as what
it makes of each single bit: 32 words."""

from __future__ import annotations

import numpy as np

BITS = 32
#: Draws of one lane; a stretch of the sequence is drawn in lanes side by side.
LANE = 256


def step(s: np.ndarray) -> np.ndarray:
    """The state after one step; the state is also the draw."""
    s = s ^ (s << np.uint32(13))
    s = s ^ (s >> np.uint32(17))
    return s ^ (s << np.uint32(5))


ONE_STEP = step(np.uint32(1) << np.arange(BITS, dtype=np.uint32))


def times(matrix: np.ndarray, states: np.ndarray) -> np.ndarray:
    """The matrix applied to each state; of another matrix's words: their product."""
    out = np.zeros_like(states)
    for bit in range(BITS):
        out ^= np.where(states >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


def power(steps: int) -> np.ndarray:
    """The matrix of so many steps."""
    out, square = np.uint32(1) << np.arange(BITS, dtype=np.uint32), ONE_STEP
    while steps:
        if steps & 1:
            out = times(square, out)
        square, steps = times(square, square), steps >> 1
    return out


def draws(seed: int, first: int, count: int) -> np.ndarray:
    """Draws first, first + 1, ... (the first draw is 0) as 32-bit words; a seed of 0 counts as 1."""
    if count <= 0:
        return np.zeros(0, np.uint32)
    lanes = -(-count // LANE)
    states, jump = times(power(first), np.array([seed & 0xFFFFFFFF or 1], np.uint32)), power(LANE)
    while len(states) < lanes:  # lanes double: those behind begin as many lanes further on
        states = np.concatenate([states, times(jump, states)])
        jump = times(jump, jump)
    states, out = states[:lanes], np.empty((LANE, lanes), np.uint32)
    for k in range(LANE):
        states = step(states)
        out[k] = states
    return out.T.ravel()[:count]


def places(words: np.ndarray, n: int) -> np.ndarray:
    """Words as places 0 to n - 1: floor(word / (2**32 - 1) * n); the largest word, which would be n, is n - 1."""
    return np.minimum(np.floor(words / np.float64(0xFFFFFFFF) * n).astype(np.int64), n - 1)
