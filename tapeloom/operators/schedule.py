"""Events in order of time and, at the same time, of arrival; any of them can be cancelled before its turn."""

from __future__ import annotations

import heapq
from typing import Any


class Scheduler:
    def __init__(self):
        self._heap: list[tuple[int, int]] = []
        self._live: dict[int, Any] = {}
        self._next = 0

    def push(self, ts: int, event: Any) -> int:
        self._next += 1
        heapq.heappush(self._heap, (ts, self._next))
        self._live[self._next] = event
        return self._next

    def cancel(self, handle: int) -> bool:
        return self._live.pop(handle, self) is not self

    def peek(self) -> tuple[int, Any] | None:
        while self._heap and self._heap[0][1] not in self._live:
            heapq.heappop(self._heap)
        return (self._heap[0][0], self._live[self._heap[0][1]]) if self._heap else None

    def pop(self) -> tuple[int, Any] | None:
        top = self.peek()
        if top:
            del self._live[heapq.heappop(self._heap)[1]]
        return top

    def clear(self) -> None:
        self._heap, self._live = [], {}

    def __len__(self) -> int:
        return len(self._live)
