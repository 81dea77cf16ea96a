"""Logging of how long a step took."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

log = logging.getLogger("isoplane")


def as_text(seconds: float) -> str:
    """``Xm YYs`` from a minute on, else ``0.0s``."""
    return f"{int(seconds // 60)}m {int(seconds % 60):02d}s" if seconds >= 60 else f"{seconds:.1f}s"


@contextmanager
def timed(label: str) -> Iterator[None]:
    """Log the duration of the block, also when it fails."""
    start = time.perf_counter()
    try:
        yield
    finally:
        log.info("%s took %s", label, as_text(time.perf_counter() - start))
