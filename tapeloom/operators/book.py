"""An ordered book for one fold: what relational plans can't say (matching, replace chains, reused references).

Levels keep their orders in arrival order; a sorted list of prices per side gives the touch."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

#: Errors of book operations.
ERRORS = ("none", "zero_ref", "bad_qty", "out_of_band", "page_exhausted", "duplicate_ref", "arena_full", "unknown_order", "over_execute")


class Book:
    def __init__(self, low: int | None = None, high: int | None = None, capacity: int | None = None):
        self.low, self.high, self.capacity = low, high, capacity
        self.orders: dict[int, list] = {}  # ref -> [side, price, remaining]
        self.levels: dict[str, dict[int, dict[int, None]]] = {"B": {}, "S": {}}
        self.totals: dict[str, dict[int, int]] = {"B": {}, "S": {}}
        self.prices: dict[str, list[int]] = {"B": [], "S": []}
        self.deltas: list[tuple[str, int, int]] = []  # (side, price, change) of the last operation

    # queries
    def best(self, side: str) -> int | None:
        p = self.prices[side]
        return (p[-1] if side == "B" else p[0]) if p else None

    def qty_at(self, side: str, price: int) -> int:
        return self.totals[side].get(price, 0)

    def remaining(self, ref: int) -> int:
        return self.orders[ref][2] if ref in self.orders else 0

    def side_of(self, ref: int) -> str:
        return self.orders[ref][0] if ref in self.orders else "?"

    def front(self, side: str, price: int) -> int | None:
        return next(iter(self.levels[side].get(price, ())), None)

    def queue(self, side: str, price: int) -> list[tuple[int, int]]:
        return [(r, self.orders[r][2]) for r in self.levels[side].get(price, ())]

    def ahead(self, ref: int) -> int:
        """Units queued before an order at its level; -1 if it isn't live."""
        if ref not in self.orders:
            return -1
        side, price, _ = self.orders[ref]
        total = 0
        for other in self.levels[side][price]:
            if other == ref:
                return total
            total += self.orders[other][2]
        return -1

    def below(self, side: str, price: int) -> int | None:
        i = bisect_left(self.prices[side], price)
        return self.prices[side][i - 1] if i else None

    def above(self, side: str, price: int) -> int | None:
        i = bisect_right(self.prices[side], price)
        return self.prices[side][i] if i < len(self.prices[side]) else None

    def l2(self) -> list[tuple[str, int, int]]:
        return [(s, p, self.totals[s][p]) for s in ("B", "S") for p in self.prices[s]]

    # operations: each returns an error name, "none" if it was done
    def add(self, ref: int, side: str, qty: int, price: int) -> str:
        self.deltas = []
        error = self._refuse_add(ref, qty, price)
        if error == "none":
            self._enter(ref, side, qty, price)
        return error

    def _outside(self, price: int | None) -> bool:
        return price is None or self.low is not None and not self.low <= price < self.high

    def _refuse_add(self, ref: int, qty: int, price: int) -> str:
        if ref == 0:
            return "zero_ref"
        if qty <= 0:
            return "bad_qty"
        if self._outside(price):
            return "out_of_band"
        if ref in self.orders:
            return "duplicate_ref"
        return "arena_full" if self.capacity is not None and len(self.orders) >= self.capacity else "none"

    def reduce(self, ref: int, qty: int) -> str:
        """Execution and partial cancel."""
        self.deltas = []
        if qty <= 0:
            return "bad_qty"
        if ref not in self.orders:
            return "unknown_order"
        if qty > self.orders[ref][2]:
            return "over_execute"
        self._take(ref, qty)
        return "none"

    def remove(self, ref: int) -> str:
        self.deltas = []
        return self.reduce(ref, self.orders[ref][2]) if ref in self.orders else "unknown_order"

    def replace(self, old: int, new: int, qty: int, price: int) -> str:
        """Keeps the side, loses the place."""
        self.deltas = []
        if qty <= 0:
            return "bad_qty"
        if self._outside(price):
            return "out_of_band"
        if old not in self.orders:
            return "unknown_order"
        if new == 0:
            return "zero_ref"
        if new != old and new in self.orders:
            return "duplicate_ref"
        side = self.orders[old][0]
        self._take(old, self.orders[old][2])
        self._enter(new, side, qty, price)
        return "none"

    def apply(self, m: dict) -> str:
        """A decoded message by its type; C changes the book as E does. Other types and messages without a reference do
        nothing. A null price is outside, a null quantity or new reference is 0."""
        kind = m["type"] if m["order_ref"] is not None else None
        if kind in ("A", "F"):
            return self.add(m["order_ref"], m["side"], m["shares"] or 0, m["price"])
        if kind in ("E", "C", "X"):
            return self.reduce(m["order_ref"], m["shares"] or 0)
        if kind == "D":
            return self.remove(m["order_ref"])
        if kind == "U":
            return self.replace(m["order_ref"], m["new_ref"] or 0, m["shares"] or 0, m["price"])
        self.deltas = []
        return "none"

    def _enter(self, ref: int, side: str, qty: int, price: int) -> None:
        if price not in self.levels[side]:
            insort(self.prices[side], price)
            self.levels[side][price], self.totals[side][price] = {}, 0
        self.orders[ref] = [side, price, qty]
        self.levels[side][price][ref] = None
        self.totals[side][price] += qty
        self.deltas.append((side, price, qty))

    def _take(self, ref: int, qty: int) -> None:
        order = self.orders[ref]
        side, price, _ = order
        order[2] -= qty
        self.totals[side][price] -= qty
        self.deltas.append((side, price, -qty))
        if not order[2]:
            del self.orders[ref], self.levels[side][price][ref]
            if not self.levels[side][price]:
                del self.levels[side][price], self.totals[side][price]
                self.prices[side].pop(bisect_left(self.prices[side], price))

    def sound(self) -> bool:
        """Orders, levels, totals and touch agree."""
        seen = {r for s in ("B", "S") for p in self.levels[s] for r in self.levels[s][p]}
        return seen == set(self.orders) and all(sum(self.orders[r][2] for r in q) == self.totals[s][p] > 0 for s in ("B", "S") for p, q in self.levels[s].items()) and all(self.prices[s] == sorted(self.levels[s]) for s in ("B", "S"))
