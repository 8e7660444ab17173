"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc

from skein.lineage import Scratch, components, fresh, materialise, shared_dir
from skein.session import table

__all__ = ["Scratch", "components", "fresh", "materialise", "shared_dir", "table", "trim"]


def trim() -> None:
    """Give freed memory back at the end of a task: workers live on, and what one stage has used must not
    burden the next. Does nothing where the C library cannot."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
