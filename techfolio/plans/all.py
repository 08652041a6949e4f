"""Imports every query module so that the registry is full."""

from . import enrichment, evaluation, ingest, model, portfolio, text  # noqa: F401
