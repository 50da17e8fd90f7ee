"""The numbers of NumPy's RandomState(seed), from any place of its stream on.

A factor that is a table is drawn in slices, by many tasks, and each needs the stream from
its own place on. The generator (MT19937) is linear over bits, so the state after J words
is a sum of the first states: those that x^J modulo the generator's characteristic
polynomial names (Haramoto, Matsumoto, Nishimura, Panneton, L'Ecuyer 2008). The polynomial
is found once for a process from the generator's own bits (Berlekamp-Massey). A number
takes two words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Words of a state, and its bits that count (of the first word only the highest does).
WORDS, BITS = 624, 19937
#: Words up to which it is quicker to step over them than to jump.
STEP = 1 << 20


def _generator(key: np.ndarray) -> np.random.MT19937:
    """The generator whose last WORDS untempered words are key."""
    bits = np.random.MT19937()
    bits.state = {"bit_generator": "MT19937", "state": {"key": key, "pos": WORDS}}
    return bits


def _key(seed: int) -> np.ndarray:
    return np.random.RandomState(seed).get_state()[1]


@lru_cache(1)
def characteristic() -> int:
    """The characteristic polynomial; bit k is the coefficient of x^k."""
    stream = _generator(_key(1)).random_raw(2 * BITS) & 1
    now, before, length, gap, seen = 1, 1, 0, 1, 0
    for n, bit in enumerate(stream.tolist()):
        seen = seen << 1 | bit  # bit i: the stream i places ago
        if not (now & seen).bit_count() & 1:
            gap += 1
        elif 2 * length <= n:
            now, before, length, gap = now ^ before << gap, now, n + 1 - length, 1
        else:
            now ^= before << gap
            gap += 1
    if length != BITS:
        raise ArithmeticError(f"a recurrence of {length} bits, not {BITS}")
    return int(f"{now:0{BITS + 1}b}"[::-1], 2)  # a connection polynomial is the reverse


@lru_cache(1)
def _multiples() -> list[int]:
    """characteristic() times every polynomial of 8 bits, by the 8 bits above BITS that it clears."""
    whole, out = characteristic(), [0] * 256
    for k in range(256):
        product = 0
        for i in range(8):
            if k >> i & 1:
                product ^= whole << i
        out[product >> BITS] = product
    return out


def _reduced(p: int) -> int:
    """p modulo the characteristic polynomial."""
    multiples = _multiples()
    while (over := p.bit_length() - BITS) > 0:
        shift = max(0, over - 8)
        p ^= multiples[p >> BITS + shift] << shift
    return p


@lru_cache(256)
def power(words: int) -> int:
    """x^words modulo the characteristic polynomial."""
    p = 1
    for bit in f"{words:b}":
        p = _reduced(int("0".join(f"{p:b}"), 2) << int(bit))  # a square moves bit k to bit 2k
    return p


@lru_cache(256)
def _terms(words: int) -> np.ndarray:
    return np.flatnonzero(np.array(list(f"{power(words):b}"[::-1])) == "1")


def _jumped(key: np.ndarray, words: int) -> np.ndarray:
    """The key of the state that is `words` words later."""
    bits, blocks = _generator(key), [key]
    while len(blocks) * WORDS < BITS + WORDS:
        bits.random_raw(WORDS, output=False)
        blocks.append(bits.state["state"]["key"].copy())
    states = np.lib.stride_tricks.sliding_window_view(np.concatenate(blocks), WORDS)
    return np.bitwise_xor.reduce(states[_terms(words)], axis=0)


def uniform(seed: int, at: int, n: int) -> np.ndarray:
    """Numbers at .. at + n - 1 that RandomState(seed).random_sample would give; at is a whole number of any size."""
    key, words = _key(seed), 2 * at
    if words > STEP:
        bits = _generator(_jumped(key, words))
    else:
        bits = _generator(key)
        bits.random_raw(words, output=False)
    return np.random.RandomState(bits).random_sample(n)
