"""Exact integer matrix products by residues: float32 products modulo small primes, joined by Chinese remaindering."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: float32 holds every integer up to this one.
EXACT = 1 << 24
#: Scores joined from residues stay below this, so that the moduli's product fits in 64 bits.
JOINED_LIMIT = 1 << 48
#: Scores of larger components are held here, so that their multiples by a hundred still fit in 64 bits.
SCORE_LIMIT = 1 << 55
CHUNK = 256


@lru_cache
def primes_below(limit: int) -> list[int]:
    """Odd primes below ``limit``, largest first."""
    sieve = np.ones(max(limit, 3), bool)
    sieve[:2] = False
    for i in range(2, int(limit**0.5) + 1):
        if sieve[i]:
            sieve[i * i :: i] = False
    return [int(p) for p in np.flatnonzero(sieve)[::-1] if p > 2]


def moduli(bound: int, chunk: int) -> list[int]:
    """Primes whose product exceeds twice ``bound``, small enough for float32 sums of ``chunk`` products of residues."""
    half = int((EXACT / chunk) ** 0.5)
    chosen, product = [], 1
    for p in primes_below(2 * half + 1):
        if product > 2 * bound:
            break
        chosen.append(p)
        product *= p
    if product <= 2 * bound:
        raise ValueError("too few primes for scores of this size")
    return chosen


def residues(values: np.ndarray, p: int) -> np.ndarray:
    """Values modulo p, between -(p - 1) / 2 and (p - 1) / 2, as float32."""
    half = (p - 1) // 2
    return ((values + half) % p - half).astype(np.float32)


def product_modulo(left: np.ndarray, right: np.ndarray, p: int, chunk: int) -> np.ndarray:
    """``left @ right.T`` modulo p (0 to p - 1); sums of ``chunk`` products are exact in float32."""
    out = np.zeros((len(left), len(right)), np.int32)
    for lo in range(0, left.shape[1], chunk):
        out += (residues(left[:, lo : lo + chunk], p) @ residues(right[:, lo : lo + chunk], p).T).astype(np.int32) % p
    return out % p


def exact_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``left @ right.T`` for int64 matrices, exactly.

    Residues are joined by mixed-radix digits, and what exceeds half of the moduli's product is
    negative. Rows with components too large for that are multiplied as Python integers
    and their scores held at the limit.
    """
    dim = left.shape[1]
    if not len(left) or not len(right) or not dim:
        return np.zeros((len(left), len(right)), np.int64)
    most = int((JOINED_LIMIT // dim) ** 0.5)
    wide_left, wide_right = (~((m >= -most) & (m <= most)).all(axis=1) for m in (left, right))
    out = np.zeros((len(left), len(right)), np.int64)
    a, b = left[~wide_left], right[~wide_right]
    if len(a) and len(b):
        out[np.ix_(~wide_left, ~wide_right)] = _joined(a, b)
    for rows, columns in ((wide_left, np.ones(len(right), bool)), (~wide_left, wide_right)):
        if rows.any() and columns.any():
            slow = left[rows].astype(object) @ right[columns].astype(object).T
            out[np.ix_(rows, columns)] = np.clip(slow, -SCORE_LIMIT, SCORE_LIMIT).astype(np.int64)
    return out


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    bound = left.shape[1] * max(1, int(np.abs(left).max())) * max(1, int(np.abs(right).max()))
    chunk = min(CHUNK, left.shape[1])
    chosen = moduli(bound, chunk)
    total, radix = product_modulo(left, right, chosen[0], chunk).astype(np.int64), chosen[0]
    for p in chosen[1:]:
        digit = (product_modulo(left, right, p, chunk) - total % p) % p * pow(radix, -1, p) % p
        total += digit * radix
        radix *= p
    total[total > radix // 2] -= radix
    return total
