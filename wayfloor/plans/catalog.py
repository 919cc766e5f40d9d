"""All queries of the engine's own operators, with their SQL counterparts."""

from __future__ import annotations

from importlib import import_module

from wayfloor.plans import registry

for _name in ("points_queries", "grid_queries", "reach_queries", "scene_queries", "terrain_queries", "path_queries"):
    import_module(f"wayfloor.plans.{_name}")


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
