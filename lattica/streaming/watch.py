"""Watching a catalog: polls its fingerprint and swaps in a new one when it changes, waiting longer while it does not."""

from __future__ import annotations

import threading
from collections.abc import Callable

from ..sources.catalog import Catalog

#: Seconds between polls at first and at most, and the growth of the wait.
FIRST, MOST, GROWTH = 30.0, 300.0, 1.5


class Watcher:
    """current is always whole: a poll builds a catalog aside and replaces it in one assignment."""

    def __init__(self, load: Callable[[], Catalog], on_change: Callable[[Catalog], None] | None = None, first: float = FIRST, most: float = MOST):
        self.load, self.on_change, self.first, self.most = load, on_change, first, most
        self.current = load()
        self.fingerprint = self.current.fingerprint()
        self.wait = first
        self.errors: list[str] = []
        self._stop = threading.Event()
        self._thread: threading.Thread | None = None

    def poll(self) -> bool:
        """Look once. A failing load leaves the current catalog in place."""
        try:
            new = self.load()
            mark = new.fingerprint()
        except Exception as e:  # whatever the source raises, the old catalog keeps serving
            self.errors.append(str(e))
            self.wait = min(self.most, self.wait * GROWTH)
            return False
        if mark == self.fingerprint:
            self.wait = min(self.most, self.wait * GROWTH)
            return False
        self.current, self.fingerprint, self.wait = new, mark, self.first
        if self.on_change:
            self.on_change(new)
        return True

    def start(self) -> None:
        def loop() -> None:
            while not self._stop.wait(self.wait):
                self.poll()

        self._thread = threading.Thread(target=loop, daemon=True)
        self._thread.start()

    def stop(self) -> None:
        self._stop.set()
        if self._thread:
            self._thread.join()
