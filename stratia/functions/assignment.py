"""Auctions: bidders without an object bid for the one they value most, at its price, until each holds one.

Whole arrays at a time: in a round all bidders without an object bid, each object takes its highest bid, and who held it
before is without one again. A bid leaves a bidder's object within eps of its best choice, so that with whole benefits and
eps times bidders below one the end is an optimal perfect assignment.
"""

from __future__ import annotations

import numpy as np

#: Least value, for bidders with one choice.
NEVER = np.iinfo(np.int64).min // 4
#: Benefits over this would leave no room for prices in 64 bits.
LARGEST = 1 << 58
#: By how much eps falls from phase to phase.
FALL = 5


def bid(start: np.ndarray, objects: np.ndarray, benefit: np.ndarray, price: np.ndarray, eps: int) -> np.ndarray:
    """The object of each bidder; price is raised in place.

    start: where each bidder's choices begin, and the end; objects and benefit: the choices. Objects that others hold at
    their price are outbid like any other.
    """
    n = len(start) - 1
    held, owner, free = np.full(n, -1), np.full(len(price), -1), np.arange(n)
    while len(free):
        count = start[free + 1] - start[free]
        first = np.cumsum(count) - count
        at = np.repeat(start[free] - first, count) + np.arange(int(count.sum()))
        value = benefit[at] - price[objects[at]]
        best = np.maximum.reduceat(value, first)
        top = np.flatnonzero(value == np.repeat(best, count))
        who = np.repeat(np.arange(len(free)), count)[top]
        top = top[np.r_[True, who[1:] != who[:-1]]]
        value[top] = NEVER
        second = np.maximum.reduceat(value, first)
        wanted = objects[at[top]]
        offer = price[wanted] + best - np.maximum(second, best - LARGEST) + eps
        order = np.lexsort((free, -offer, wanted))
        wins = order[np.r_[True, wanted[order][1:] != wanted[order][:-1]]]
        got, taken = free[wins], wanted[wins]
        lost = owner[taken]
        held[lost[lost >= 0]] = -1
        owner[taken], held[got], price[taken] = got, taken, offer[wins]
        free = np.flatnonzero(held < 0) if len(free) * 4 > n else np.sort(np.concatenate([np.delete(free, wins), lost[lost >= 0]]))
    return held


def falling(benefit: np.ndarray) -> list[int]:
    """Values of eps, from a quarter of the largest benefit down to one."""
    eps = max(1, int(benefit.max(initial=1)) // 4)
    out = [eps]
    while eps > 1:
        eps = max(1, eps // FALL)
        out.append(eps)
    return out


def solve(start: np.ndarray, objects: np.ndarray, benefit: np.ndarray, n_objects: int) -> tuple[np.ndarray, np.ndarray]:
    """(object of each bidder, price of each object): optimal, if benefits are multiples of more than the bidders' number."""
    price, held = np.zeros(n_objects, np.int64), np.full(len(start) - 1, -1)
    for eps in falling(benefit):
        held = bid(start, objects, benefit, price, eps)
    return held, price


def gap(start: np.ndarray, objects: np.ndarray, benefit: np.ndarray, held: np.ndarray, price: np.ndarray) -> int:
    """By how much the prices' bound exceeds the assignment's value: bidders' best values and prices, less what they hold."""
    value = benefit - price[objects]
    owner = np.repeat(np.arange(len(start) - 1), np.diff(start))
    mine = objects == held[owner]
    return int(np.maximum.reduceat(value, start[:-1]).sum() - value[mine].sum())
