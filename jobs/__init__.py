"""Runnable jobs: ``python -m jobs.intake`` and ``python -m jobs.enrich``."""
