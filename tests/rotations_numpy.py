"""Rotations in numpy, which the column expressions are held against."""

from __future__ import annotations

import numpy as np

AXES = {"r": 0, "p": 1, "y": 2}
SIZES = {"axis_angle": 3, "quaternion": 4, "rotation_6d": 6, "matrix": 9}


def _about(axis: int, a: np.ndarray) -> np.ndarray:
    m = np.zeros((len(a), 3, 3))
    i, j = (axis + 1) % 3, (axis + 2) % 3
    m[:, axis, axis] = 1
    m[:, i, i] = m[:, j, j] = np.cos(a)
    m[:, i, j], m[:, j, i] = -np.sin(a), np.sin(a)
    return m


def to_matrix(v: np.ndarray, kind: str) -> np.ndarray:
    """(n, 3, 3) from rows of a representation; `euler_angles_xyz` style names take letters r, p and y."""
    v = np.asarray(v, float)
    if kind == "matrix":
        return v.reshape(-1, 3, 3)
    if kind == "quaternion":
        w, x, y, z = (v / np.linalg.norm(v, axis=1, keepdims=True)).T
        return np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)], 1).reshape(-1, 3, 3)
    if kind == "axis_angle":
        angle = np.linalg.norm(v, axis=1)
        half = angle / 2
        scale = np.where(angle > 1e-9, np.sin(half) / np.maximum(angle, 1e-300), 0.5)
        return to_matrix(np.concatenate([np.cos(half)[:, None], v * scale[:, None]], 1), "quaternion")
    if kind == "rotation_6d":
        a, b = v[:, :3], v[:, 3:]
        x = a / np.linalg.norm(a, axis=1, keepdims=True)
        y = b - (x * b).sum(1, keepdims=True) * x
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        return np.stack([x, y, np.cross(x, y)], 1)
    if kind.startswith("euler_angles_"):
        m = np.broadcast_to(np.eye(3), (len(v), 3, 3))
        for k, letter in enumerate(kind.removeprefix("euler_angles_")):
            m = m @ _about(AXES[letter], v[:, k])
        return m
    raise ValueError(f"unknown rotation {kind!r}")


def from_matrix(m: np.ndarray, kind: str) -> np.ndarray:
    if kind == "matrix":
        return m.reshape(-1, 9)
    if kind == "rotation_6d":
        return m[:, :2].reshape(-1, 6)
    if kind in ("quaternion", "axis_angle"):
        t = np.stack([m[:, 0, 0] + m[:, 1, 1] + m[:, 2, 2], m[:, 0, 0] - m[:, 1, 1] - m[:, 2, 2], m[:, 1, 1] - m[:, 0, 0] - m[:, 2, 2], m[:, 2, 2] - m[:, 0, 0] - m[:, 1, 1]], 1)
        big = t.argmax(1)
        d, s, u = m[:, 2, 1] - m[:, 1, 2], m[:, 0, 2] - m[:, 2, 0], m[:, 1, 0] - m[:, 0, 1]
        p, q, r = m[:, 1, 0] + m[:, 0, 1], m[:, 0, 2] + m[:, 2, 0], m[:, 2, 1] + m[:, 1, 2]
        lead = np.sqrt(np.maximum(t[np.arange(len(m)), big] + 1, 0)) / 2
        rows = np.stack([np.stack([4 * lead**2, d, s, u], 1), np.stack([d, 4 * lead**2, p, q], 1), np.stack([s, p, 4 * lead**2, r], 1), np.stack([u, q, r, 4 * lead**2], 1)], 1)
        quat = rows[np.arange(len(m)), big] / (4 * np.maximum(lead, 1e-300))[:, None]
        quat *= np.where(quat[:, :1] < 0, -1, 1)
        if kind == "quaternion":
            return quat
        norm = np.linalg.norm(quat[:, 1:], axis=1)
        angle = 2 * np.arctan2(norm, quat[:, 0])
        return quat[:, 1:] * np.where(norm > 1e-9, angle / np.maximum(norm, 1e-300), 2.0)[:, None]
    if kind.startswith("euler_angles_"):
        i, j, k = (AXES[c] for c in kind.removeprefix("euler_angles_"))
        sign = 1.0 if (j - i) % 3 == 1 else -1.0
        middle = np.arcsin(np.clip(sign * m[:, i, k], -1, 1))
        return np.stack([np.arctan2(-sign * m[:, j, k], m[:, k, k]), middle, np.arctan2(-sign * m[:, i, j], m[:, i, i])], 1)
    raise ValueError(f"unknown rotation {kind!r}")
