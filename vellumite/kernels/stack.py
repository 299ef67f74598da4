"""Documents nested deeper than Python's recursion limit."""

from __future__ import annotations

import sys
import threading
from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")
#: Bytes of the stack beside Python's own frames, of which what is touched is taken; beyond it Python raises RecursionError.
STACK = 256 << 20
FRAMES = 1000


def with_frames(call: Callable[[], T], frames: int) -> T:
    """call(), and where that goes too deep once more in a thread with so many frames."""
    try:
        return call()
    except RecursionError:
        if frames <= sys.getrecursionlimit():
            raise
    got: list[T] = []
    failed: list[Exception] = []

    def run() -> None:
        try:
            got.append(call())
        except Exception as e:  # noqa: BLE001 (raised again where it was called)
            failed.append(e)

    limit, size = sys.getrecursionlimit(), threading.stack_size(STACK)
    try:
        sys.setrecursionlimit(frames)
        thread = threading.Thread(target=run)
        thread.start()
        thread.join()
    finally:
        sys.setrecursionlimit(limit)
        threading.stack_size(size)
    if failed:
        raise failed[0]
    return got[0]
