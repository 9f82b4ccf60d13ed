"""Options read while a plan is built."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

RETAIN = "Retain"
MIGRATE = "Migrate"


@dataclass(frozen=True)
class MigrationFilters:
    """Scope of a run; ``None`` leaves a rule out."""

    from_utc: datetime | None = None
    to_utc: datetime | None = None
    archive_id: str | None = None
    folder_path: str | None = None
    retention_category: str | None = None


@dataclass(frozen=True)
class Extensions:
    """Own steps of a run.

    ``extra_rules``: (reason, rule column) pairs that skip an item, after the filters.
    ``check_parts``: (refs, parts, blob hashes) -> checked references.
    ``build_messages``: (items, part lists, options) -> messages.
    """

    extra_rules: tuple[tuple[str, Any], ...] = ()
    check_parts: Callable[..., Any] | None = None
    build_messages: Callable[..., Any] | None = None


@dataclass(frozen=True)
class RunOptions:
    run_id: str
    as_of: datetime
    legal_hold: str = RETAIN
    dry_run: bool = False
    filters: MigrationFilters = field(default_factory=MigrationFilters)
    tool_version: str = "1.0.0"
    extensions: Extensions = field(default_factory=Extensions)

    def __post_init__(self) -> None:
        if self.legal_hold not in (RETAIN, MIGRATE):
            raise ValueError(f"legal_hold must be {RETAIN} or {MIGRATE}, got {self.legal_hold!r}")
