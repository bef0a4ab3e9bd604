"""Settings of an engine: its model endpoint."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Endpoint:
    """A model endpoint, from the environment or from a file of ``NAME=value`` lines (names of variables are fixed)."""

    model: str = ""
    url: str = ""
    key: str = ""

    @classmethod
    def load(cls, path: str | None = None) -> Endpoint:
        """Values of a file come before those of the environment; blank lines and ``#`` lines don't count."""
        own = dict(os.environ)
        if path and Path(path).exists():
            for line in Path(path).read_text(encoding="utf-8").splitlines():
                name, found, value = line.strip().removeprefix("export ").partition("=")
                if found and not name.startswith("#"):
                    own[name.strip()] = value.strip().strip("\"'")
        return cls(own.get("LLM_MODEL_NAME", ""), own.get("LLM_BASE_URL", ""), own.get("LLM_API_KEY", ""))
