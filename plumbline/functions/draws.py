"""Random draws from counters: the same words whatever the partitions, the order or the engine. Philox 4x32 with ten rounds, uniform numbers of
53 bits, normal numbers in pairs, and truncated normal ones by the inverse distribution function."""

from __future__ import annotations

import math

import numpy as np

#: Fixed values of the generator: two multipliers, two steps of the key, and its rounds.
MULTIPLIERS = (0xD2511F53, 0xCD9E8D57)
STEPS = (0x9E3779B9, 0xBB67AE85)
ROUNDS = 10
#: Coefficients of Wichura's rational approximations of the normal inverse (AS 241), from the constant term upward; near
#: the middle, in the tails, and far out.
MIDDLE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
TAIL = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)
_WORD = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)


def philox(counter: tuple, key: tuple[int, int]) -> list[np.ndarray]:
    """Four words of 32 bits (in uint64) for each counter: four integers or arrays below 2^32 that broadcast. They are broadcast as late as the
    rounds mix them."""
    a, b, c, d = (np.asarray(x, np.uint64) for x in counter)
    k0, k1 = key

    def mixed(product: np.ndarray, low: np.ndarray, k: int) -> np.ndarray:
        out = (product >> _HALF) ^ (low ^ np.uint64(k) if low.size < product.size else low)
        if low.size >= product.size:
            out ^= np.uint64(k)
        return out

    for _ in range(ROUNDS):
        p, q = a * np.uint64(MULTIPLIERS[0]), c * np.uint64(MULTIPLIERS[1])
        a, c = mixed(q, b, k0), mixed(p, d, k1)
        b, d = q & _WORD, p & _WORD
        k0, k1 = (k0 + STEPS[0]) & 0xFFFFFFFF, (k1 + STEPS[1]) & 0xFFFFFFFF
    return list(np.broadcast_arrays(a, b, c, d))


def uniform(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """A number in (0, 1) from two words: 53 bits and a half."""
    bits = (high >> np.uint64(5)) << np.uint64(26)
    bits |= low >> np.uint64(6)
    out = bits.view(np.int64).astype(float)
    out += 0.5
    out *= 2.0**-53
    return out


def normal_pair(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two normal numbers from four words, by Box and Muller."""
    size, angle = np.sqrt(-2 * np.log(uniform(words[0], words[1]))), 2 * np.pi * uniform(words[2], words[3])
    return size * np.cos(angle), size * np.sin(angle)


def normal_inverse(p: np.ndarray) -> np.ndarray:
    """The normal number with probability p (in (0, 1)) below it."""
    ratio = lambda r, table: np.polyval(table[0][::-1], r) / np.polyval(table[1][::-1], r)
    q = p - 0.5
    out = q * ratio(0.180625 - q * q, MIDDLE)
    outside = np.abs(q) > 0.425
    far = p[outside]
    r = np.sqrt(-np.log(np.minimum(far, 1 - far)))
    tail = ratio(r - 1.6, TAIL)
    beyond = r > 5
    tail[beyond] = ratio(r[beyond] - 5, FAR)
    out[outside] = np.copysign(tail, q[outside])
    return out


def normal_share(x: float) -> float:
    """The probability below x."""
    return 0.5 * math.erfc(-x / math.sqrt(2))


def truncated_normal(u: np.ndarray, mean: float, sd: float, low: float, high: float) -> np.ndarray:
    """A normal number between two bounds for each uniform one; the mean where sd is 0. Bounds with next to nothing between them are an
    error."""
    if sd <= 0:
        return np.full(len(u), float(mean))
    below, above = normal_share((low - mean) / sd), normal_share((high - mean) / sd)
    if not above - below > 1e-9:
        raise ValueError(f"no {len(u)} draws of N({mean}, {sd}) between {low} and {high}")
    return mean + sd * normal_inverse(below + u * (above - below))
