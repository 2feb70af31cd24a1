"""Synthetic frames with known slope, offset, channel and noise, and amplitude series with a known rhythm."""

from __future__ import annotations

import numpy as np

from ..operators.kernels import FREQUENCIES, PLACES


def phase_frames(n: int, slope: float, offset: float | np.ndarray = 0.0, amplitude: float = 40.0, noise: float = 0.0, echo: tuple[float, float] = (0.0, 0.0), seed: int = 0) -> np.ndarray:
    """(n, 128) interleaved [imaginary, real] in int8; echo: strength and delay in samples; guard places are 0."""
    rng = np.random.default_rng(seed)
    h = amplitude * np.exp(1j * (slope * FREQUENCIES + np.asarray(offset).reshape(-1, 1)))
    h = h * (1 + echo[0] * np.exp(-2j * np.pi * FREQUENCIES * echo[1] / 64))
    h = np.broadcast_to(h, (n, 52)) + noise * (rng.standard_normal((n, 52)) + 1j * rng.standard_normal((n, 52)))
    out = np.zeros((n, 128))
    out[:, 2 * PLACES], out[:, 2 * PLACES + 1] = h.imag, h.real
    return np.clip(np.rint(out), -128, 127).astype(np.int8)


def amplitude_series(n: int, rate: float, hz: float | None, strength: float = 0.05, width: int = 52, seed: int = 0) -> np.ndarray:
    """(width, n) series around 1 with noise, and a rhythm of phase by place unless hz is None."""
    rng = np.random.default_rng(seed)
    t = np.arange(n) / rate
    x = 1 + 0.02 * rng.standard_normal((width, n))
    return x if hz is None else x + strength * np.sin(2 * np.pi * hz * t + rng.uniform(0, 2 * np.pi, (width, 1)))
