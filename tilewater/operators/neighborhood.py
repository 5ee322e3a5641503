"""The eight neighbours of a raster cell."""

from __future__ import annotations

#: neighbour -> (row step, column step, distance, direction code)
NEIGHBORS = {
    "n_e": (0, 1, 1.0, 1), "n_se": (1, 1, 2.0 ** 0.5, 2), "n_s": (1, 0, 1.0, 4), "n_sw": (1, -1, 2.0 ** 0.5, 8),
    "n_w": (0, -1, 1.0, 16), "n_nw": (-1, -1, 2.0 ** 0.5, 32), "n_n": (-1, 0, 1.0, 64), "n_ne": (-1, 1, 2.0 ** 0.5, 128),
}
