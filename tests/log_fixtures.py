"""Where the log files of the tests lie; a module of its own, as ``conftest`` names several files."""

from __future__ import annotations

from pathlib import Path

FIXTURES = Path(__file__).resolve().parent / "fixtures"
