"""Imports every module that registers queries."""

from __future__ import annotations

from importlib import import_module

MODULES = ("q_scans", "q_joins", "q_panel", "q_metrics", "q_replay", "q_views", "q_models", "q_sinks", "q_stateful", "q_fits", "q_features", "q_worlds", "q_composition")


def load() -> None:
    for name in MODULES:
        import_module(f"asoflow.plans.{name}")
