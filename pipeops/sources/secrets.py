"""Secret references: ``secret://NAME`` stands for the environment variable NAME."""

from __future__ import annotations

import os
from collections.abc import Mapping

PREFIX = "secret://"


def resolve(value: object) -> object:
    if isinstance(value, str) and value.startswith(PREFIX):
        name = value[len(PREFIX) :]
        if name not in os.environ:
            raise KeyError(f"secret {name} is not set in the environment")
        return os.environ[name]
    return value


def resolve_options(options: Mapping[str, object] | None) -> dict[str, object]:
    """Options in sorted order, secrets looked up, so that reads are reproducible."""
    return {str(key): resolve(options[key]) for key in sorted(options or {})}
