"""One registered query per operator; importing this package fills the registry."""

from importlib import import_module

from massweave.queries._base import ORACLES, QUERIES

for _m in ("sources", "cleaning", "reshape", "joins", "curves", "draws", "stats", "ranking", "tables", "checks", "streaming"):
    import_module(f"massweave.queries.{_m}")

__all__ = ["QUERIES", "ORACLES"]
