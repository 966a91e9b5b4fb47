"""Reproducible synthetic samples."""

from __future__ import annotations

SEED = 0x000A0510


def lcg_samples(count: int, seed: int = SEED) -> list[int]:
    """Counts from -8000 to 8000 by a linear congruential generator modulo 2**32."""
    out = []
    for _ in range(count):
        seed = (1664525 * seed + 1013904223) % 2**32
        out.append((seed >> 8) % 16001 - 8000)
    return out
