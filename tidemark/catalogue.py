"""All queries of the library's own operators and their SQL."""

from .plans import clean, composed, ingest, jobs, learning, phases, scalars, series, stats, streams, verify
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "clean", "composed", "ingest", "jobs", "learning", "phases", "scalars", "series", "stats", "streams", "verify"]
