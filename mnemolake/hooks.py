"""Lifecycle hooks: extensions that are told what happens and cannot break it."""

from __future__ import annotations

import importlib
import logging
from collections.abc import Callable
from importlib.metadata import entry_points

EVENTS = ("startup", "shutdown", "store", "recall", "forget", "consolidation_start", "consolidation_complete", "topic_created", "topic_updated", "contradiction", "prune")
_LOG = logging.getLogger(__name__)


class Hooks:
    """Callables by event, called in order of registration; an error is logged and the next one called."""

    def __init__(self) -> None:
        self._held: dict[str, list[Callable]] = {e: [] for e in EVENTS}

    def register(self, plugin: object) -> None:
        """Takes a plugin's on_<event> methods."""
        for e in EVENTS:
            if callable(f := getattr(plugin, f"on_{e}", None)):
                self._held[e].append(f)

    def load(self, names: list[str] = (), group: str = "mnemolake.plugins") -> None:
        """Plugins by dotted path (module:Class), and those that installed packages offer."""
        for name in names:
            module, _, attribute = name.partition(":")
            self.register(getattr(importlib.import_module(module), attribute)())
        for point in entry_points(group=group):
            self.register(point.load()())

    def fire(self, event: str, **about: object) -> int:
        """How many hooks took the event without an error."""
        if event not in self._held:
            raise ValueError(f"no such event: {event}")
        done = 0
        for f in self._held[event]:
            try:
                f(**about)
                done += 1
            except Exception:
                _LOG.exception("hook %s failed", event)
        return done
