"""Content-chosen anchors of byte strings: how equal windows of two texts find each other.

Every window of ``window`` bytes points at the ``gram`` bytes inside it that hash lowest (leftmost
among equals). Equal windows point at equal grams, at the same distance; so windows can only be
equal if their anchors are, and each anchor stands for the run of windows that point at it.
"""

from __future__ import annotations

import numpy as np

from planwright.llm.tokens import mix

_BASE = 0x9E3779B97F4A7C15
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_PLACE = np.uint64((1 << 24) - 1)
#: Bytes that are looked at together; a longer text is looked at in overlapping parts.
BLOCK = 1 << 20
_power: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.full(max(n, BLOCK + 4096), base, np.uint64)
            out[0] = 1
            _power[name] = np.multiply.accumulate(out)
    return _power["up"], _power["down"]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of x[i : i + w], for every i with that many left."""
    n = len(x) - w + 1
    pad = -len(x) % w
    rows = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def anchors(texts: list[bytes], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, gram hash, segment hash, from, to): windows from .. to (starts) of a text point at one
    anchor; the segment is the bytes that they cover."""
    found: list[tuple[np.ndarray, ...]] = []
    group: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if group:
            found.append(_block(group, window, gram))
            group.clear()
            size = 0

    for i, t in enumerate(texts):
        if len(t) < window:
            continue
        for at in range(0, len(t) - window + 1, BLOCK):
            part = t[at : at + BLOCK + window - 1] if len(t) > BLOCK else t
            if size + len(part) > BLOCK and group:
                flush()
            group.append((i, at, part))
            size += len(part)
            if part is t:
                break
    flush()
    if not found:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    return tuple(np.concatenate(c) for c in zip(*found))


def _block(group: list[tuple[int, int, bytes]], window: int, gram: int) -> tuple[np.ndarray, ...]:
    sizes = np.array([len(g[2]) for g in group])
    starts = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"".join([g[2] for g in group]), np.uint8)
    n = len(raw)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[raw] * up[:n], out=sums[1:])
    grams = mix((sums[gram:] - sums[: n + 1 - gram]) * down[: n + 1 - gram])
    best = _sliding_min((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), window - gram + 1)
    valid = np.zeros(len(best) + 1, np.int8)
    np.add.at(valid, starts, 1)
    np.add.at(valid, np.minimum(starts + sizes - window + 1, len(best)), -1)
    ok = np.cumsum(valid[:-1]) > 0
    place = (best & _PLACE).astype(np.int64)
    new = ok.copy()
    new[1:] &= ~ok[:-1] | (place[1:] != place[:-1])
    new[starts[starts < len(new)]] = ok[starts[starts < len(new)]]
    first = np.flatnonzero(new)
    end = ok.copy()
    end[:-1] &= ~ok[1:] | new[1:]
    last = np.flatnonzero(end)
    segment = mix((sums[last + window] - sums[first]) * down[first] + (last - first).astype(np.uint64))
    of = np.searchsorted(starts, first, "right") - 1
    text, offset = np.array([g[0] for g in group]), np.array([g[1] for g in group])
    return text[of], grams[place[first]], segment, first - starts[of] + offset[of], last - starts[of] + offset[of]


def gram_place(part: bytes, g: int, windows: int, window: int, gram: int) -> int:
    """Where the gram of hash ``g`` (as a signed number) lies in a segment of so many windows that all
    point at it: the first place that is in every window."""
    x = np.frombuffer(part, np.uint8)
    up, down = _powers(len(x) + 1)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(_TABLE[x] * up[: len(x)], out=sums[1:])
    grams = mix((sums[gram:] - sums[: len(x) + 1 - gram]) * down[: len(x) + 1 - gram])
    at = np.flatnonzero(grams[windows - 1 : window - gram + 1] == np.uint64(g % (1 << 64)))
    return windows - 1 + int(at[0])
