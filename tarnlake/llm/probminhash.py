"""ProbMinHash sketches: registers that agree with the probability Jaccard similarity of two bags.

Every distinct shingle of a text is a Poisson process whose rate is its weight (how often it occurs). Its
arrivals go to registers chosen at random; a register keeps the shingle that arrives first. Two texts agree
in a register with probability J_P, the probability Jaccard similarity of their weighted shingles. Arrivals
of a shingle come in order of time, so a shingle stops as soon as its arrival is later than the slowest
register of its text (Ertl, "ProbMinHash", 2020).
"""

from __future__ import annotations

import numpy as np

from tarnlake.llm.shingles import mix, multiple

_LOW_48 = np.uint64((1 << 48) - 1)


def weighted(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) pairs: number of the text, 48 bits of the hash, and how often it occurs."""
    texts = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
    keys = np.sort((texts << np.uint64(48)) | (hashes >> np.uint64(16)))
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.float64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    weights = np.diff(np.concatenate([first, [len(keys)]])).astype(np.float64)
    keys = keys[first]
    return (keys >> np.uint64(48)).astype(np.int64), keys & _LOW_48, weights


def repeated(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The numbers of the texts in which a shingle occurs twice or more."""
    text, _, weight = weighted(hashes, offsets)
    return np.unique(text[weight > 1])


def sketch(hashes: np.ndarray, offsets: np.ndarray, registers: int = 252, plain: bool = False) -> np.ndarray:
    """A row of ``registers`` 16-bit fragments for each text, at most 65,536 texts; zeros without shingles.

    With ``plain`` all weights are 1, and the registers agree with the plain Jaccard similarity.
    """
    if registers > 2048:
        raise ValueError("at most 2048 registers: an arrival chooses among so many")
    n = len(offsets) - 1
    text, seed, weight = weighted(hashes, offsets)
    if plain:
        weight = np.ones_like(weight)
    # High half: time of the first arrival as a float, whose bits sort like its value; low half: the shingle.
    best = np.full(n * registers, np.uint64(0xFFFFFFFFFFFFFFFF))
    seed = mix(seed)
    label = seed & np.uint64(0xFFFFFFFF)
    time = np.zeros(len(seed))
    slowest = np.zeros(n, np.uint64)
    step = 0
    while len(text):
        step += 1
        bits = mix(seed + multiple(step))
        time = time - np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        slot = text * registers + ((bits & np.uint64(0x7FF)) * np.uint64(registers) >> np.uint64(11)).astype(np.int64)
        packed = (time.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | label
        np.minimum.at(best, slot, packed)
        # The slowest register of each text that goes on; the bits of an empty register are above all times.
        present = np.flatnonzero(np.bincount(text, minlength=n))
        slowest[present] = best.reshape(n, registers)[present].max(1) >> np.uint64(32)
        going = (packed >> np.uint64(32)) <= slowest[text]
        text, seed, label, time, weight = text[going], seed[going], label[going], time[going], weight[going]
    out = (best & np.uint64(0xFFFF)).astype(np.uint16).reshape(n, registers)
    out[np.diff(offsets) == 0] = 0
    return out


def bag(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes in order, and how often each occurs."""
    return np.unique(hashes, return_counts=True)


def jaccard(left: tuple, right: tuple) -> float:
    """Exact Jaccard similarity of the sets of two bags."""
    common = len(np.intersect1d(left[0], right[0], assume_unique=True))
    union = len(left[0]) + len(right[0]) - common
    return common / union if union else 0.0


def similarity(left: tuple, right: tuple) -> float:
    """Exact probability Jaccard of two bags given as (sorted distinct hashes, counts).

    ``sum_i 1 / sum_j max(x_j / x_i, y_j / y_i)`` over the common elements i and all elements j.
    """
    (a, x), (b, y) = left, right
    if not len(a) or not len(b):
        return 0.0
    common, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    cx, cy = x[at_a].astype(np.float64), y[at_b].astype(np.float64)
    rest_x, rest_y = float(x.sum() - cx.sum()), float(y.sum() - cy.sum())
    # max(x_j / x_i, y_j / y_i) is x_j / x_i where x_j / y_j >= x_i / y_i: one pass in order of the ratio.
    ratio = cx / cy
    order = np.argsort(ratio, kind="stable")
    cx, cy = cx[order], cy[order]
    above = np.cumsum(cx[::-1])[::-1]
    below = np.cumsum(cy) - cy
    return float(np.sum(1.0 / ((above + rest_x) / cx + (below + rest_y) / cy)))
