"""Many pairs of terms at once: what each of some terms shares with each of others, as matrices.

Terms of one frame (the labels of inner nodes, leaves left open) are walked together, so that a place of two frames costs one
comparison of arrays and not one a pair. The results are those of terms.generalise and terms.scores, pair by pair.
"""

from __future__ import annotations

import numpy as np

from stratia.functions import terms


class Frame:
    """Terms of one frame: their subterms' numbers by place, in preorder."""

    def __init__(self, labels: list) -> None:
        self.labels, self.rows, self.subs, self.open, self.weight = labels, [], [], [], []
        self.ends = [0] * len(labels)
        todo: list[tuple[int, int]] = []  # inner places and how many children are to come
        for i, label in enumerate(labels):
            if label is not None:
                todo.append((i, label[2]))
                continue
            end = i + 1
            self.ends[i] = end
            while todo:
                at, left = todo.pop()
                if left > 1:
                    todo.append((at, left - 1))
                    break
                self.ends[at] = end

    def close(self) -> None:
        self.rows, self.subs, self.open, self.weight = np.array(self.rows), np.array(self.subs, np.int64), np.array(self.open, bool), np.array(self.weight, float)


def frames(encodings: list[str], numbers: dict, weigh) -> list[Frame]:
    """The terms by frame; numbers: a table of subterms that both sides share; weigh: what a node counts, by tag and data."""
    out: dict = {}
    known: dict = {}
    for row, encoding in enumerate(encodings):
        nodes = list(terms.walk(terms.parse("x-stmt-v1;" + encoding)))
        labels = tuple((t[0], t[1], len(t) - 2) if len(t) > 2 else None for t in nodes)
        if labels not in out:
            out[labels] = Frame(list(labels))
        frame = out[labels]
        frame.rows.append(row)
        frame.subs.append([numbers.setdefault(t, len(numbers)) for t in nodes])
        for t in nodes:
            if t not in known:
                known[t] = terms.loose(t) > 0
        frame.open.append([known[t] for t in nodes])
        frame.weight.append([weigh(t[0], t[1]) for t in nodes])
    for frame in out.values():
        frame.close()
    return list(out.values())


def _places(a: Frame, b: Frame) -> tuple[list, list]:
    """(inner places of a that agree, places (p, q, depth, both leaves) where the walk down both frames ends)."""
    inner, ends, todo = [], [], [(0, 0, 0)]
    while todo:
        p, q, depth = todo.pop()
        x, y = a.labels[p], b.labels[q]
        if x is not None and x == y:
            inner.append(p)
            under, pa, qb = terms.binds((x[0], x[1], *[None] * x[2])), p + 1, q + 1
            for u in under:
                todo.append((pa, qb, depth + u))
                pa, qb = a.ends[pa], b.ends[qb]
        else:
            ends.append((p, q, depth, x is None and y is None))
    return inner, ends


def shared(a: Frame, b: Frame, variables: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weight of the shared part, variables, variables that hide a bound one) of each row of a with each of b."""
    inner, ends = _places(a, b)
    size = len(a.rows), len(b.rows)
    common = np.repeat(a.weight[:, inner].sum(1)[:, None], size[1], 1)
    n, scoped, before = np.zeros(size, np.int32), np.zeros(size, np.int32), []
    for p, q, depth, leaves in ends:
        x, y = a.subs[:, p], b.subs[:, q]
        differ = x[:, None] != y[None, :] if leaves else np.ones(size, bool)
        if leaves:
            common += ~differ * a.weight[:, p][:, None]
        if not variables:
            continue
        open_, new = a.open[:, p][:, None] | b.open[:, q][None, :], differ
        for x2, y2, depth2 in before:
            one, other = x == x2, y == y2
            if one.any() and other.any():
                again = one[:, None] & other[None, :]
                new = new & ~(again if depth == depth2 else again & ~open_)
        before.append((x, y, depth))
        n += new
        scoped += new & open_
    return common, n, scoped


def compared(left: list[str], right: list[str], weigh, variables: bool = True) -> tuple[np.ndarray, ...]:
    """(shared, variables, scoped, left's weight, right's weight): three matrices and two vectors."""
    numbers: dict = {}
    a, b = frames(left, numbers, weigh), frames(right, numbers, weigh)
    out = [np.zeros((len(left), len(right)), t) for t in (float, np.int32, np.int32)]
    for f in a:
        for g in b:
            at = np.ix_(f.rows, g.rows)
            for whole, part in zip(out, shared(f, g, variables), strict=True):
                whole[at] = part
    wide = [np.zeros(len(left)), np.zeros(len(right))]
    for vector, side in zip(wide, (a, b), strict=True):
        for f in side:
            vector[f.rows] = f.weight.sum(1)
    return (*out, *wide)


def counted(tag: str, data) -> float:
    """One for a node that is neither a hole nor a variable."""
    return float(tag not in "_?")
