"""Composed jobs and the registry of named queries."""

from tablewright.plans.job import DEFAULT_CONFIG, build_frame, check_config, run, target_table, transform

__all__ = ["DEFAULT_CONFIG", "build_frame", "check_config", "run", "target_table", "transform"]
