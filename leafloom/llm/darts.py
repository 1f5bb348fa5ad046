"""DartMinHash sketches of weighted sets, many sets at a time.

Each element owns a stack of unit regions, one for each (weight cell, rank
cell). A hash of (element, cell, cell) says how many darts land in a region
(Poisson with mean 1) and, for each dart, its exact weight and rank position
and one of K coordinates. A set keeps the darts below its elements' weights and
below a rank limit that lets about K (ln K + 3) darts through; the dart of the
least rank wins its coordinate. The regions belong to the elements, not to the
set, so two sets agree in a coordinate with the probability of their weighted
Jaccard similarity. Where a coordinate got no dart, the limit is doubled.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash

U = np.uint64
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(14)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> U(11)).astype(np.float64) * 2.0**-53


def shingles(text: str, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct runs of ``width`` words (all words if fewer), sorted, and how often each occurs."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, U), np.empty(0, np.int64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(w) for w in words), U, len(words))
    width = min(width, len(h))
    out = np.zeros(len(h) - width + 1, U)
    for k in range(width):
        out = out * U(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k]
    return np.unique(mix(out), return_counts=True)


def _cells(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, number within the owner) of count[i] cells for each i."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)


def sketch(sets: list[np.ndarray], weights: list[np.ndarray] | None, k: int) -> np.ndarray:
    """len(sets) x k dart names; each set has an element at least. weights: None for 1."""
    out = np.zeros((len(sets), k), U)
    mass = np.array([float(len(s)) if weights is None else float(weights[i].sum()) for i, s in enumerate(sets)])
    limit = k * (math.log(k) + 3) / mass
    todo = np.arange(len(sets))
    while len(todo):
        size = np.array([len(sets[i]) for i in todo])
        elem, of = np.concatenate([sets[i] for i in todo]), np.repeat(np.arange(len(todo)), size)
        weight = np.ones(len(elem)) if weights is None else np.concatenate([weights[i] for i in todo]).astype(float)
        row, w_cell = _cells(np.ceil(weight).astype(np.int64))
        at, r_cell = _cells(np.ceil(limit[todo])[of[row]].astype(np.int64))
        row, w_cell = row[at], w_cell[at]
        region = mix(elem[row] ^ mix(w_cell.astype(U) * U(0xD6E8FEB86659FD93) + r_cell.astype(U) + U(1)))
        at, n = _cells(np.searchsorted(_POISSON, _unit(region), side="right"))
        dart = mix(region[at] + (n.astype(U) + U(1)) * U(0x9E3779B97F4A7C15))
        rank = r_cell[at] + _unit(mix(dart ^ U(0xA0761D6478BD642F)))
        doc = of[row[at]]
        ok = rank <= limit[todo][doc]
        if weights is not None:
            ok &= w_cell[at] + _unit(mix(dart ^ U(0xE7037ED1A0B428DB))) < weight[row[at]]
        dart, rank, doc = dart[ok], rank[ok], doc[ok]
        slot = doc * k + (mix(dart ^ U(0x8EBC6AF09C88C6E3)) % U(k)).astype(np.int64)
        scale = 2.0**40 / (limit[todo].max() + 1)
        order = np.argsort(slot.astype(U) << U(40) | (rank * scale).astype(U), kind="stable")
        slot, dart = slot[order], dart[order]
        first = np.ones(len(slot), bool)
        first[1:] = slot[1:] != slot[:-1]
        found = np.zeros(len(todo) * k, bool)
        found[slot[first]] = True
        flat = np.zeros(len(todo) * k, U)
        flat[slot[first]] = dart[first]
        full = found.reshape(-1, k).all(1)
        out[todo[full]] = flat.reshape(-1, k)[full]
        todo = todo[~full]
        limit[todo] *= 2
    return out


def bands(sketches: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit name for each run of ``rows`` coordinates, as signed integers."""
    n, k = sketches.shape
    x = sketches[:, : k // rows * rows].reshape(n, k // rows, rows)
    h = np.broadcast_to(np.arange(k // rows, dtype=U)[None], x.shape[:2]).copy()
    for c in range(rows):
        h = mix(h * U(0x9E3779B97F4A7C15) + x[:, :, c])
    return h.view(np.int64)
