"""Registered queries, grouped by topic."""

from importlib import import_module
from pathlib import Path


def load_all() -> None:
    """Import every topic module so that its queries register themselves."""
    for path in sorted(Path(__file__).parent.glob("q_*.py")):
        import_module(f"{__name__}.{path.stem}")
