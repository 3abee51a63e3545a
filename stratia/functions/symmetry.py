"""Motifs of symmetry in one statement: its two sides, or a premise and what it gives, compared with one another.

INV: one side is the other with something wrapped around parts of it. SWAP: the sides are the same parts in another
order. CONS: one side does not depend on a variable that the other has. INV_IMP and SWAP_IMP: the first two between a
premise and its consequence.
"""

from __future__ import annotations

from stratia.functions import terms

#: Differences between two sides that are still looked at.
MOST_WRAPPED, MOST_SWAPPED = 16, 8
FIELDS = ("motif", "strict", "variables", "context", "shape", "direction", "head", "arity", "whole")


def free(term, depth: int = 0) -> set[int]:
    """Indices of bound variables from outside the term."""
    if term[0] == "b":
        return {term[1] - depth} if term[1] >= depth else set()
    return set().union(*(free(c, depth + u) for c, u in zip(term[2:], terms.binds(term), strict=True)))


def lowered(term, depth: int = 0):
    """The term one binder further out; it does not use that binder."""
    if term[0] == "b":
        return ("b", term[1] - 1) if term[1] > depth else term
    return (*term[:2], *(lowered(c, depth + u) for c, u in zip(term[2:], terms.binds(term), strict=True)))


def _head(term) -> str:
    head = terms.spine(term)[0]
    return head[1][0] if head[0] == "c" else {"b": "?bvar", "l": "?binder", "p": "?binder"}.get(head[0], "?")


def context(big, small) -> tuple[str, str] | None:
    """The path from a term to an inner one that equals `small`, arguments first: with the heads of what it passes, and bare.

    Binders are not entered: below one, the same index is another variable.
    """
    if big == small:
        return None
    todo, seen = [(big, (), ())], set()
    while todo:
        t, names, steps = todo.pop()
        if t == small:
            return "|".join(names), "|".join(steps)
        if t in seen:
            continue
        seen.add(t)
        if t[0] == "a":
            todo.append((t[2], (*names, f"a0:{_head(t[3])}"), (*steps, "a0")))
            todo.append((t[3], (*names, f"a1:{_head(t[2])}"), (*steps, "a1")))
        elif t[0] == "j":
            todo.append((t[2], (*names, f"j:{t[1][0]}"), (*steps, "j")))
    return None


def wrapped(left, right) -> dict | None:
    skeleton, pairs, _ = terms.generalise(left, right)
    pairs = list(dict.fromkeys(pairs))
    if not pairs or len(pairs) > MOST_WRAPPED:
        return None
    found = []
    for a, b in pairs:
        out, back = context(b, a), context(a, b)
        if (out is None) == (back is None):
            return None
        found.append(("L<R", *out) if back is None else ("R<L", *back))
    if len({d for d, _, _ in found}) != 1:
        return None
    names, shapes = (sorted({f[i] for f in found}) for i in (1, 2))
    return {"motif": "INV", "strict": len(names) == 1, "variables": len(pairs), "context": "+".join(names), "shape": "+".join(shapes), "direction": found[0][0], "whole": terms.concrete(skeleton) == 0}


def swapped(left, right) -> dict | None:
    skeleton, pairs, _ = terms.generalise(left, right)
    pairs = list(dict.fromkeys(pairs))
    if not 2 <= len(pairs) <= MOST_SWAPPED or terms.concrete(skeleton) == 0:
        return None
    if sorted(map(repr, (a for a, _ in pairs))) != sorted(map(repr, (b for _, b in pairs))):
        return None
    return {"motif": "SWAP", "strict": True, "variables": len(pairs), "context": None, "shape": None, "direction": "swap", "whole": False}


def motifs(term) -> list[dict]:
    """The motifs of a statement, one of each kind at most; of implications the outermost."""
    infos, t = [], term
    while t[0] == "p":
        infos.append(t[1])
        t = t[3]
    head, args = terms.spine(t)
    name = head[1][0] if head[0] == "c" else None
    out: dict[str, dict] = {}

    def put(hit: dict | None, motif: str, arity: int) -> None:
        if hit and motif not in out:
            out[motif] = {**hit, "motif": motif, "head": name, "arity": arity}

    if name is not None and len(args) >= 2:
        left, right = args[-2:]
        put(wrapped(left, right), "INV", len(args))
        put(swapped(left, right), "SWAP", len(args))
        put(dropped(left, right, infos), "CONS", len(args))
    t = term
    while t[0] == "p":
        if terms.concrete(t[2]) > 2 and 0 not in free(t[3]):
            given = lowered(t[3])
            put(wrapped(t[2], given), "INV_IMP", -1)
            put(swapped(t[2], given), "SWAP_IMP", -1)
        t = t[3]
    return [out[m] for m in sorted(out)]


def dropped(left, right, infos: list[str]) -> dict | None:
    """CONS: variables bound explicitly that one side alone depends on; strict if the other depends on none at all."""
    explicit = {len(infos) - 1 - i for i, info in enumerate(infos) if info == "d"}
    l, r = free(left), free(right)
    gone = (l - r) & explicit or (r - l) & explicit
    if not gone or terms.concrete(left) <= 1 or terms.concrete(right) < 1:
        return None
    leftwards = bool((l - r) & explicit)
    return {"motif": "CONS", "strict": not (r if leftwards else l), "variables": len(gone), "context": None, "shape": None, "direction": "L>R" if leftwards else "R>L", "whole": False}
