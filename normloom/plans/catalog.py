"""All queries of the core and their equivalent SQL."""

from __future__ import annotations

from normloom.plans import problems, reference

QUERIES = {**reference.QUERIES, **problems.QUERIES}
ORACLES = {**reference.ORACLES, **problems.ORACLES}
