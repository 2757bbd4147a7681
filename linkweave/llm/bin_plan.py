"""How to fill bins from a count of items by length: dominance reduction, then best fit.

A plan depends only on how many items each length has, so it is made from a table of at most ``capacity`` numbers, whatever the size of
the corpus, and whole batches of equal bins are fixed at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

#: A bin's lengths, the largest first, and how many such bins.
Plan = Counter[tuple[int, ...]]


class Stock:
    """Items by length."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.n = [0] * (capacity + 1)
        for length, n in counts.items():
            if not 0 < length <= capacity:
                raise ValueError(f"no bin holds an item of {length}")
            self.n[length] += n

    def lengths(self, without: tuple[int, ...] = (), above: int = 0) -> Iterator[int]:
        """Lengths over ``above`` of what is left without some items, one for each item, the smallest first."""
        for x in range(above + 1, self.capacity + 1):
            for _ in range(min(self.n[x] - without.count(x), 3)):
                yield x

    def largest(self, most: int, without: tuple[int, ...] = ()) -> int:
        """The largest length up to ``most`` that is left without some items, or 0."""
        return next((x for x in range(most, 0, -1) if self.n[x] > without.count(x)), 0)

    def take(self, items: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
        """As many bins of these items as there are."""
        need = Counter(items)
        times = min(self.n[x] // k for x, k in need.items())
        for x, k in need.items():
            self.n[x] -= k * times
        return tuple(sorted(items, reverse=True)), times

    def best_pair(self, j: int) -> int:
        """The largest sum of two items that fit beside one of length j."""
        room = self.capacity - j
        return max((a + b for a in range(room - 1, 0, -1) if self.n[a] > (a == j) and (b := self.largest(min(a, room - a), (j, a)))), default=0)


def dominating(stock: Stock, j: int) -> tuple[int, ...] | None:
    """A set with an item of length j that is at least as good as any other set with it: each other one's further items
    could change places with this one's without overfilling any bin. None if no such set of three or fewer is known."""
    room = stock.capacity - j
    rest = stock.lengths((j,))
    s1, s2, s3 = (next(rest, stock.capacity + 1) for _ in range(3))
    if s1 > room:
        return (j,)
    r = stock.largest(room, (j,))
    if r == room or s1 + s2 > room:  # a full bin, or no third item fits: the largest second one is best
        return (j, r)
    if s1 + s2 + s3 <= room:
        return None
    pair = stock.best_pair(j)
    if r >= pair:
        return (j, r)
    b = stock.largest(room - r, (j, r))
    if b and r + b == pair:
        larger = stock.lengths((j,), b)
        x1, x2 = next(larger, stock.capacity + 1), next(larger, stock.capacity + 1)
        if x1 + x2 > room:  # of any two items beside j one is at most b, the other at most r
            return (j, r, b)
    return None


def reduced(stock: Stock) -> Plan:
    """Takes dominating sets out of the stock, for each length from the largest, until none is found."""
    plan: Plan = Counter()
    found = True
    while found:
        found = False
        for j in range(stock.capacity, 0, -1):
            while stock.n[j] and (items := dominating(stock, j)):
                bins, times = stock.take(items)
                plan[bins] += times
                found = True
    return plan


def best_fit(stock: Stock) -> Plan:
    """All of the stock, the largest items first, each to the fullest bin that has room for it."""
    free: dict[int, Plan] = {}
    for length in range(stock.capacity, 0, -1):
        n, stock.n[length] = stock.n[length], 0
        while n:
            room = min((r for r in free if r >= length), default=stock.capacity)
            held, bins = free[room].popitem() if room in free else ((), n)
            if room in free and not free[room]:
                del free[room]
            each = min(room // length, n)  # an item that was put into a bin leaves it the fullest for the next
            times = min(bins, n // each)
            free.setdefault(room - each * length, Counter())[held + (length,) * each] += times
            n -= times * each
            if held and bins > times:
                free.setdefault(room, Counter())[held] += bins - times
    plan: Plan = Counter()
    for held in free.values():
        plan.update(held)
    return plan


def planned(counts: dict[int, int], capacity: int) -> Plan:
    stock = Stock(counts, capacity)
    return reduced(stock) + best_fit(stock)
