"""Whole jobs: telemetry views of the star-schema tables, registered queries, run report."""
