"""Texts of prompts, read once."""

from __future__ import annotations

import os
import re
from functools import lru_cache


@lru_cache(maxsize=256)
def load(folder: str, name: str) -> str:
    """The text of a file of that name in the folder; names that are paths are refused."""
    if not re.fullmatch(r"[A-Za-z0-9_-][A-Za-z0-9_.-]*", name):
        raise ValueError(f"no such prompt: {name}")
    with open(os.path.join(folder, name), encoding="utf-8") as f:
        return f.read().strip()
