"""NumPy kernels of dynamic programming on pairs of sequences; rows of a matrix are vectors."""

from __future__ import annotations

import numpy as np

LOW = -(1 << 40)


def score_table(match: int, mismatch: int, size: int = 128) -> np.ndarray:
    table = np.full((size, size), mismatch, np.int64)
    np.fill_diagonal(table, match)
    return table


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("latin-1", "replace"), np.uint8).astype(np.int64) % 128


def _matrix_rows(a: np.ndarray, b: np.ndarray, table: np.ndarray, gap: tuple[int, int] | int, local: bool, terminal: bool, band: tuple[int, int] | None):
    """The rows of the score matrices from the first on, as (m, x, y); only the row before is held."""
    opening, extend = (gap, gap) if isinstance(gap, int) else gap
    linear = isinstance(gap, int)
    n, k = len(a), len(b)
    low = np.full(k + 1, LOW, np.int64)
    cols = np.arange(k + 1)
    ramp = cols * extend
    edge = lambda size: np.zeros(size, np.int64) if not terminal else opening + np.arange(size) * extend
    m, x, y = low.copy(), low.copy(), low.copy()
    if local:
        m[:] = 0
    else:
        m[0], y[1:] = 0, edge(k)
    first = edge(n)
    yield m, x, y
    for i in range(1, n + 1):
        top = np.maximum(np.maximum(m, x), y)
        from_m = np.maximum(m, y) if linear else m
        down = np.maximum(from_m + opening, x + extend)
        if not terminal and not local:
            down[k] = max(m[k], x[k], y[k] if linear else LOW)
        if local:
            down = np.where(down > 0, down, LOW)
        m, x, y = low.copy(), down, low.copy()
        m[1:] = top[:-1] + table[a[i - 1], b]
        if local:
            m[0], x[0] = 0, LOW
            m[1:] = np.maximum(m[1:], 0)
        else:
            x[0] = first[i - 1]
        if band is not None:
            off = (cols - i < band[0]) | (cols - i > band[1])
            m[off], x[off] = LOW, LOW
            if local:
                m[0] = 0
        source = np.maximum(m, x) if linear else m
        if not terminal and not local and i == n:
            y[1:] = np.maximum.accumulate(source)[:-1]
        else:
            y[1:] = np.maximum.accumulate(source + opening - extend - ramp)[:-1] + ramp[1:]
        if local:
            y = np.where(y > 0, y, LOW)
        if band is not None:
            y[off] = LOW
        yield m, x, y


def fill(a: np.ndarray, b: np.ndarray, table: np.ndarray, gap: tuple[int, int] | int, *, local: bool = False, terminal: bool = True, band: tuple[int, int] | None = None):
    """Score matrices (m, x, y) of (n + 1, k + 1) cells: ending in a pair, in a gap of b, in a gap of a.

    A linear gap is an affine one whose opening and extension cost the same, with
    gap states free to follow each other. Along a row the gap of a is a running maximum:
    y[j] = max over i < j of (m or x)[i] + open + extend * (j - i - 1).
    """
    return tuple(np.stack(rows) for rows in zip(*_matrix_rows(a, b, table, gap, local, terminal, band), strict=True))


def best_score(a: np.ndarray, b: np.ndarray, table: np.ndarray, gap, *, local: bool = False, terminal: bool = True, band=None) -> int:
    """The score alone: memory for two rows, whatever the sequences' lengths."""
    best, last = 0, 0
    for m, x, y in _matrix_rows(a, b, table, gap, local, terminal, band):
        if local:
            best = max(best, int(m.max()))
        last = m[-1], x[-1], y[-1]
    return best if local else int(max(last))


def traceback(a: np.ndarray, b: np.ndarray, table: np.ndarray, gap, *, local: bool = False, terminal: bool = True, band=None, most: int = 1) -> tuple[int, list[np.ndarray]]:
    """The best score and at most ``most`` traces, each an (columns, 2) array with -1 for gaps.

    Among steps that give the same score a pair comes first, then a gap of b, then a gap of a.
    """
    opening, extend = (gap, gap) if isinstance(gap, int) else gap
    linear = isinstance(gap, int)
    mats = fill(a, b, table, gap, local=local, terminal=terminal, band=band)
    n, k = len(a), len(b)
    if local:
        top = int(max(0, mats[0].max()))
        if not top:
            return 0, [np.zeros((0, 2), np.int64)]
        starts = [(int(i), int(j), 0) for i, j in np.argwhere(mats[0] == top)]
    else:
        top = int(max(s[-1, -1] for s in mats))
        starts = [(n, k, s) for s in range(3) if mats[s][-1, -1] == top]
    out: list[np.ndarray] = []

    def into(i: int, j: int, s: int) -> list[tuple[int, int, int]]:
        value = mats[s][i, j]
        if s == 0:
            return [(i - 1, j - 1, t) for t in range(3) if mats[t][i - 1, j - 1] + table[a[i - 1], b[j - 1]] == value]
        free = not terminal and not local and (j == k or j == 0 if s == 1 else i == n or i == 0)
        pi, pj = (i - 1, j) if s == 1 else (i, j - 1)
        return [
            (pi, pj, t)
            for t in range(3)
            if mats[t][pi, pj] > LOW // 2 and (t in (0, s) or linear) and mats[t][pi, pj] + (0 if free else extend if t == s else opening) == value
        ]

    stack = [(start, ()) for start in reversed(starts)]
    while stack and len(out) < most:
        (i, j, s), path = stack.pop()
        if (local and s == 0 and mats[0][i, j] == 0) or (not local and i == 0 and j == 0):
            out.append(np.array(path[::-1], np.int64).reshape(-1, 2))
            continue
        step = (i - 1, j - 1) if s == 0 else (i - 1, -1) if s == 1 else (-1, j - 1)
        for before in reversed(into(i, j, s)):
            stack.append((before, (*path, step)))
    return top, out


def extend(a: np.ndarray, b: np.ndarray, i: int, j: int, table: np.ndarray, threshold: int) -> tuple[int, int, int]:
    """X-drop extension from a seed pair in both directions: (score, pairs before the seed, pairs from the seed on).

    Ties extend; it ends when the best score exceeds the current one by more than the threshold.
    """

    def run(scores: np.ndarray) -> tuple[int, int]:
        if not len(scores):
            return 0, 0
        total = np.cumsum(scores)
        top = np.maximum(np.maximum.accumulate(total), 0)
        stop = np.flatnonzero(top - total > threshold)
        total = total[: stop[0]] if len(stop) else total
        if not len(total) or total.max() < 0:
            return 0, 0
        at = len(total) - 1 - int(np.argmax(total[::-1]))
        return int(total[at]), at + 1

    right = min(len(a) - i, len(b) - j) - 1
    seed = int(table[a[i], b[j]])
    up, n_up = run(table[a[i + 1 : i + 1 + right], b[j + 1 : j + 1 + right]])
    left = min(i, j)
    down, n_down = run(table[a[i - left : i][::-1], b[j - left : j][::-1]])
    return seed + up + down, n_down, n_up + 1


def gapped_local_from_seed(a: np.ndarray, b: np.ndarray, i: int, j: int, table: np.ndarray, gap, threshold: int) -> int:
    """Gapped X-drop score around a seed pair: both directions' best prefix alignments, cells below best - threshold dropped."""

    def run(p: np.ndarray, q: np.ndarray) -> int:
        opening, ext = (gap, gap) if isinstance(gap, int) else gap
        best, width = 0, len(q) + 1
        m = np.full(width, LOW, np.int64)
        m[0] = 0
        x = np.full(width, LOW, np.int64)
        ramp = np.arange(width) * ext
        y = np.full(width, LOW, np.int64)
        y[1:] = np.maximum.accumulate(m + opening - ext - ramp)[:-1] + ramp[1:]
        y[y < best - threshold] = LOW
        for c in p:
            before = np.maximum(np.maximum(m, x), y)
            nx = np.maximum(m + opening, x + ext)
            nm = np.full(width, LOW, np.int64)
            nm[1:] = before[:-1] + table[c, q]
            ny = np.full(width, LOW, np.int64)
            ny[1:] = np.maximum.accumulate(nm + opening - ext - ramp)[:-1] + ramp[1:]
            best = max(best, int(nm.max()))
            for v in (nm, nx, ny):
                v[v < best - threshold] = LOW
            m, x, y = nm, nx, ny
            if max(m.max(), x.max(), y.max()) <= LOW // 2:
                break
        return best

    return int(table[a[i], b[j]]) + run(a[i + 1 :], b[j + 1 :]) + run(a[:i][::-1], b[:j][::-1])


def identity(trace: np.ndarray, sequences: list[np.ndarray], mode: str = "not_terminal") -> float:
    """Share of columns in which all sequences have one symbol; denominators: all, not_terminal, shortest."""
    rows = np.stack([np.where(trace[:, i] >= 0, s[np.maximum(trace[:, i], 0)] if len(s) else -1, -1) for i, s in enumerate(sequences)], axis=1)
    same = (rows == rows[:, :1]).all(axis=1) & (rows[:, 0] >= 0)
    if mode == "all":
        length = len(rows)
    elif mode == "shortest":
        length = min(map(len, sequences))
    elif mode == "not_terminal":
        starts = [np.flatnonzero(c >= 0) for c in rows.T]
        low, high = max((s[0] if len(s) else len(rows)) for s in starts), min((s[-1] + 1 if len(s) else 0) for s in starts)
        if high <= low:
            raise ValueError("the sequences do not overlap")
        same, length = same[low:high], high - low
    else:
        raise ValueError(mode)
    return float(same.sum() / length)


def cigar(trace: np.ndarray, a: np.ndarray | None = None, b: np.ndarray | None = None, *, distinguish: bool = False) -> str:
    """Operations of a trace whose first row is the reference, the second the segment."""
    ops = np.where(trace[:, 0] < 0, "I", np.where(trace[:, 1] < 0, "D", "M"))
    if distinguish:
        pair = ops == "M"
        ops[pair] = np.where(a[trace[pair, 0]] == b[trace[pair, 1]], "=", "X")
    out, at = [], 0
    while at < len(ops):
        to = at
        while to < len(ops) and ops[to] == ops[at]:
            to += 1
        out.append(f"{to - at}{ops[at]}")
        at = to
    return "".join(out)


def trace_of_cigar(text: str, position: int = 0) -> np.ndarray:
    """The trace of a CIGAR; soft-clipped symbols move the segment, hard-clipped ones nothing."""
    ref, seg, rows, number = position, 0, [], ""
    for c in text:
        if c.isdigit():
            number += c
            continue
        n, number = int(number), ""
        if c in "M=X":
            rows += zip(range(ref, ref + n), range(seg, seg + n), strict=True)
            ref, seg = ref + n, seg + n
        elif c == "I":
            rows += ((-1, s) for s in range(seg, seg + n))
            seg += n
        elif c in "DN":
            rows += ((r, -1) for r in range(ref, ref + n))
            ref += n
        elif c == "S":
            seg += n
        elif c != "H":
            raise ValueError(f"unsupported CIGAR operation {c}")
    return np.array(rows, np.int64).reshape(-1, 2)
