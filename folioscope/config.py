"""Settings of the engine; one set of defaults for all operators."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class Settings:
    """Effective defaults of a run."""

    source_lang: str = "English"
    target_lang: str = "Português Brasileiro"
    max_batch_size: int = 10
    max_batch_chars: int = 2200
    min_translatable_chars: int = 3
    validation_method: str = "hybrid"
    validation_mode: str = "25%"
    fidelity_threshold: int = 90
    render_dpi: int = 300
    timeout_s: int = 300
    options: dict = field(default_factory=dict)

    def merged(self, stored: str | None) -> Settings:
        """These settings with those of a stored JSON object over them, key by key; unreadable or null text changes nothing."""
        try:
            over = json.loads(stored or "{}")
        except ValueError:
            over = {}
        known = {k: v for k, v in over.items() if k in asdict(self)} if isinstance(over, dict) else {}
        return Settings(**(asdict(self) | known))


def read_json(path: str, default: dict) -> dict:
    """The object stored at a path over `default`; a missing, unreadable or other file is the default."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError):
        return dict(default)
    return default | found if isinstance(found, dict) else dict(default)


def write_json(path: str, value: dict) -> None:
    """Store an object whole or not at all: written beside its place and then renamed."""
    part = f"{path}.{os.getpid()}.part"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, ensure_ascii=False)
    os.replace(part, path)


CONTROL = {"command": "run", "model": "default"}
STATE = {"status": "idle", "current_book": None, "current_page": 0, "total_pages": 0, "book_index": 0, "total_books": 0, "completed_books": []}
