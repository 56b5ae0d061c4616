"""Multiple alignment of a stack: a guide tree, profiles joined along it, and refinement one sequence at a time.

Scores are sums over pairs: a match, a mismatch, a base beside a gap; gaps
before the first and behind the last base of a sequence cost nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Scores of an alignment, as for pairs.
MATCH, MISMATCH, GAP = 2, -4, -5
#: Bases of a word by which the guide tree compares sequences, and passes of refinement at most.
WORD, PASSES = 4, 2

_GAP = ord("-")


def _rows(aligned: list[str]) -> np.ndarray:
    return np.frombuffer("".join(aligned).encode(), dtype=np.uint8).reshape(len(aligned), -1)


def _profile(rows: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts of each letter a column, inner gaps a column)."""
    base = rows != _GAP
    inner = np.maximum.accumulate(base, axis=1) & np.maximum.accumulate(base[:, ::-1], axis=1)[:, ::-1]
    return np.stack([(rows == x).sum(axis=0) for x in letters]).astype(np.int64), (inner & ~base).sum(axis=0).astype(np.int64)


def score(aligned: list[str] | np.ndarray) -> int:
    """Sum of the scores of all pairs of rows."""
    rows = _rows(aligned) if isinstance(aligned, list) else aligned
    letters = np.setdiff1d(np.unique(rows), [_GAP])
    if not len(letters):
        return 0
    counts, gaps = _profile(rows, letters)
    n, squares = counts.sum(axis=0), (counts**2).sum(axis=0)
    return int((MATCH * (squares - n) // 2 + MISMATCH * (n * n - squares) // 2 + GAP * n * gaps).sum())


def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The rows of ``x`` over those of ``y``, columns aligned to the greatest score of pairs across."""
    letters = np.setdiff1d(np.union1d(x, y), [_GAP])
    (cx, gx), (cy, gy) = _profile(x, letters), _profile(y, letters)
    nx, ny, n, m = cx.sum(axis=0), cy.sum(axis=0), x.shape[1], y.shape[1]
    across = (MATCH - MISMATCH) * (cx.T @ cy) + MISMATCH * np.outer(nx, ny) + GAP * (np.outer(nx, gy) + np.outer(gx, ny))
    down, right = GAP * nx * len(y), np.r_[0, np.cumsum(GAP * ny * len(x))]
    table = np.zeros((n + 1, m + 1), dtype=np.int64)
    for i in range(1, n + 1):
        row = table[i - 1] + down[i - 1]
        row[0], row[m] = 0, table[i - 1, m]  # beside the ends of y gaps are free
        row[1:] = np.maximum(row[1:], table[i - 1, :-1] + across[i - 1])
        table[i] = np.maximum.accumulate(row) if i == n else np.maximum.accumulate(row - right) + right
    i, j, px, py = n, m, [], []
    while i or j:
        if i and j and table[i, j] == table[i - 1, j - 1] + across[i - 1, j - 1]:
            i, j = i - 1, j - 1
            px.append(i)
            py.append(j)
        elif i and table[i, j] == table[i - 1, j] + (0 if j in (0, m) else down[i - 1]):
            i -= 1
            px.append(i)
            py.append(-1)
        else:
            j -= 1
            px.append(-1)
            py.append(j)
    take = lambda rows, at: np.where(at < 0, np.uint8(_GAP), rows[:, np.maximum(at, 0)])
    return np.concatenate([take(x, np.array(px[::-1])), take(y, np.array(py[::-1]))])


def guide_tree(seqs: list[str]) -> list[tuple[int, int]]:
    """Joins of groups by average distance of their words, nearest first; group n + k is the k-th join."""
    n = len(seqs)
    words = np.zeros((n, 257), dtype=np.int64)
    for i, s in enumerate(seqs):
        codes = np.frombuffer(s.encode(), dtype=np.uint8).astype(np.int64)
        if len(codes) >= WORD:
            h = np.zeros(len(codes) - WORD + 1, dtype=np.int64)
            for k in range(WORD):
                h = h * 31 + codes[k : len(codes) - WORD + 1 + k]
            words[i] = np.bincount(h % 257, minlength=257)
    most = np.maximum(np.minimum.outer(words.sum(axis=1), words.sum(axis=1)), 1)
    near = np.stack([np.minimum(words[i], words).sum(axis=1) for i in range(n)]) / most
    near[np.arange(n), np.arange(n)] = -1.0
    name, size, out = list(range(n)), np.ones(n), []
    for k in range(n - 1):
        i, j = sorted(divmod(int(near.argmax()), n))
        out.append((name[i], name[j]))
        near[i] = near[:, i] = (size[i] * near[i] + size[j] * near[j]) / (size[i] + size[j])
        size[i], size[j], name[i] = size[i] + size[j], 0, n + k
        gone = (size == 0) | (np.arange(n) == i)
        near[i, gone] = near[gone, i] = near[j] = near[:, j] = -1.0
    return out


def _without_empty(rows: np.ndarray) -> np.ndarray:
    return rows[:, (rows != _GAP).any(axis=0)]


def progressive(seqs: list[str]) -> np.ndarray:
    """Rows of different, non-empty sequences in their order, aligned along the guide tree and refined."""
    n = len(seqs)
    groups: dict[int, tuple[list[int], np.ndarray]] = {i: ([i], _rows([s])) for i, s in enumerate(seqs)}
    for k, (a, b) in enumerate(guide_tree(seqs)):
        (one, x), (two, y) = groups.pop(a), groups.pop(b)
        groups[n + k] = (one + two, joined(x, y))
    order, rows = next(iter(groups.values()))
    rows = rows[np.argsort(order)]
    best = score(rows)
    for _ in range(PASSES if n > 2 and rows.shape[1] > min(map(len, seqs)) else 0):
        before = best
        for i in range(n):
            rest = _without_empty(np.delete(rows, i, axis=0))
            again = joined(rest, _rows([seqs[i]]))
            again = np.insert(again[:-1], i, again[-1], axis=0)
            if (value := score(again)) > best:
                rows, best = again, value
        if best == before:
            break
    return rows


def align(seqs: list[str], other: Callable[[list[str]], list[str]] | None = None) -> list[str]:
    """The sequences with gaps, all of one length; letters keep their case.

    ``other`` is a second way to align (first sequence first), used where its
    score is higher.  Empty sequences and placeholders of N alone are not
    aligned but filled up with gaps.
    """
    upper = [s.upper() for s in seqs]
    different = list(dict.fromkeys(s for s in upper if s.strip("N"))) or [max(upper, key=len, default="")]
    place = {s: i for i, s in enumerate(different)}
    if len(different) == 1:
        rows = [different[0]]
    else:
        found = progressive(different)
        rows = [bytes(r).decode() for r in found]
        if other:
            second = other(different)
            weight = [place[s] for s in upper if s in place]  # repeated sequences count as often as they come
            if score([second[i] for i in weight]) > score(found[weight]):
                rows = second
    wide = len(rows[0])
    out = []
    for s, u in zip(seqs, upper, strict=True):
        if u not in place:
            out.append(s.ljust(wide, "-"))
            continue
        letters = iter(s)
        out.append("".join("-" if c == "-" else next(letters) for c in rows[place[u]]))
    wide = max(map(len, out), default=0)
    return [r.ljust(wide, "-") for r in out]
