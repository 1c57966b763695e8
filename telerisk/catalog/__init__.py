"""Registered queries, grouped as the operator inventory groups them."""

from importlib import import_module, util

for _name in ("sources_sinks", "expressions", "joins", "aggregates", "occlusion", "windows", "ordering", "models", "quality_checks",
              "streams_catalog"):
    if util.find_spec(f"telerisk.catalog.{_name}"):
        import_module(f"telerisk.catalog.{_name}")

from telerisk.catalog.registry import ORACLES, QUERIES  # noqa: E402,F401
