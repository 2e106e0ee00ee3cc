"""Settings of a run: defaults, overridden by a TOML file."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    chunk_threshold: int = 12_000
    chunk_size: int = 10_000
    chunk_overlap: int = 400
    folder_depth: int = 3
    fat_folder: int = 8
    audit_chunk: int = 12
    report_rows: int = 1_000


def load(path: str | None = None, folder: str = ".") -> Settings:
    """Settings of ``path``, else of ``docloom.toml`` in ``folder``, else the defaults; unknown names are an error."""
    name = path or os.path.join(folder, "docloom.toml")
    if path is None and not os.path.exists(name):
        return Settings()
    with open(name, "rb") as source:
        given = tomllib.load(source)
    known = {f.name for f in fields(Settings)}
    if unknown := set(given) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return Settings(**given)
