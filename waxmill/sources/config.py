"""Configuration files."""

from __future__ import annotations

import configparser
import json
from dataclasses import dataclass, fields
from pathlib import Path

from waxmill.functions.text import TRUE_TEXTS


@dataclass(frozen=True)
class Config:
    api_key: str = ""
    music_folder: str = ""
    destination_folder: str = ""
    dup_folder: str = ""
    unresolved_folder: str = ""
    db_path: str = ""
    dry_run: bool = True
    prune: bool = False
    hashAudio: bool = False
    global_dedup: bool = False
    process: bool = True


def flag(value: object, default: bool) -> bool:
    if value is None:
        return default
    return value.strip().lower() in TRUE_TEXTS if isinstance(value, str) else bool(value)


def read_config(path: str) -> Config:
    """A JSON file's known keys; flags may be written as text; what is missing has its default."""
    given = json.loads(Path(path).read_text(encoding="utf-8"))
    values = {f.name: flag(given.get(f.name), f.default) if isinstance(f.default, bool) else str(given.get(f.name) or f.default) for f in fields(Config)}
    return Config(**values)


def write_default_config(path: str) -> None:
    Path(path).write_text(json.dumps({f.name: f.default for f in fields(Config)}, indent=2), encoding="utf-8")


def read_folders(path: str, section: str = "Settings") -> tuple[str | None, str | None]:
    """source_dir and target_dir of an INI file; (None, None) if it can't be read."""
    parser = configparser.ConfigParser()
    try:
        parser.read(path, encoding="utf-8")
        return parser.get(section, "source_dir"), parser.get(section, "target_dir")
    except (configparser.Error, OSError, UnicodeDecodeError):
        return None, None
