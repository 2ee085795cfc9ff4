"""Requests side by side within a task, bounded per host, with results in the order of the rows."""

from __future__ import annotations

import time
from collections import Counter, deque
from collections.abc import Callable, Hashable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass


@dataclass(frozen=True)
class Politeness:
    """Bounds of one task. The client must be safe to call from ``in_flight`` threads at once.

    A host's links go to a few tasks (``tasks_per_host``), so a host sees at most that many times
    ``per_host`` requests at once, and as often a start every ``pause`` seconds.
    """

    in_flight: int = 8
    per_host: int = 2
    pause: float = 0.0
    # Rows whose requests may be started or finished ahead of the oldest one; their bodies are held.
    window: int = 16


class _Entry:
    __slots__ = ("chain", "future", "host", "row")

    def __init__(self, row: tuple, host: str, chain: Hashable) -> None:
        self.row, self.host, self.chain = row, host, chain
        self.future: Future | None = None


class _Window:
    """The rows ahead, oldest first, and what runs for them."""

    def __init__(
        self, polite: Politeness, pool: ThreadPoolExecutor, work: Callable[[tuple], tuple], won: Callable[[tuple], bool]
    ) -> None:
        self.polite, self.pool, self.work, self.won = polite, pool, work, won
        self.entries: deque[_Entry] = deque()
        self.running: dict[Future, str] = {}
        self.busy: Counter[str] = Counter()
        self.last_start: dict[str, float] = {}

    def start(self) -> float | None:
        """Start what the bounds allow; seconds until a pause ends, if one holds a row back."""
        now, soonest = time.monotonic(), None
        held: set[Hashable] = set()
        for entry in self.entries:
            if entry.chain in held:
                continue
            if entry.chain is not None and not self._lost(entry.future):
                held.add(entry.chain)
            if entry.future is not None or len(self.running) >= self.polite.in_flight or self.busy[entry.host] >= self.polite.per_host:
                continue
            ready = self.last_start.get(entry.host, -1e18) + self.polite.pause
            if ready > now:
                soonest = min(ready - now, soonest if soonest is not None else ready - now)
                continue
            self.last_start[entry.host] = now
            self.busy[entry.host] += 1
            entry.future = self.pool.submit(self.work, entry.row)
            self.running[entry.future] = entry.host
        if len(self.last_start) > 4 * self.polite.window:
            self.last_start = {h: t for h, t in self.last_start.items() if t + self.polite.pause > now}
        return soonest

    def _lost(self, future: Future | None) -> bool:
        """Whether a row has been tried in vain, so that the next of its chain may be."""
        return future is not None and future.done() and not self.won(future.result())

    def settle(self, timeout: float | None) -> None:
        """Wait until a request ends, at most ``timeout`` seconds."""
        if self.running:
            done, _ = wait(self.running, timeout, FIRST_COMPLETED)
            for future in done:
                self.busy[self.running.pop(future)] -= 1
        elif timeout:
            time.sleep(timeout)


def in_order(
    rows: Iterable[tuple],
    host_of: Callable[[tuple], str],
    work: Callable[[tuple], tuple],
    polite: Politeness,
    chain_of: Callable[[tuple], Hashable] | None = None,
    won: Callable[[tuple], bool] = bool,
) -> Iterator[tuple[tuple, tuple]]:
    """(row, result of ``work``) in the order of the rows.

    Rows of one chain, which follow each other, run one after the other; once ``won`` holds for a
    result the rest of its chain is skipped. ``work`` must not raise.
    """
    source = iter(rows)
    over: object = object()  # the chain that has been won
    with ThreadPoolExecutor(polite.in_flight) as pool:
        ahead = _Window(polite, pool, work, won)
        more = True
        while True:
            while more and len(ahead.entries) < polite.window:
                row = next(source, None)
                if row is None:
                    more = False
                    break
                chain = chain_of(row) if chain_of else None
                if chain_of is None or chain != over:
                    ahead.entries.append(_Entry(row, host_of(row), chain))
            if not ahead.entries:
                return
            soonest = ahead.start()
            head = ahead.entries[0]
            if head.future is None or not head.future.done():
                ahead.settle(soonest)
                continue
            ahead.entries.popleft()
            result = head.future.result()
            yield head.row, result
            if chain_of is not None and won(result):
                # What is left of the chain has not been started.
                over = head.chain
                while ahead.entries and ahead.entries[0].chain == over:
                    ahead.entries.popleft()
