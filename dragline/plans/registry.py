"""All registered queries."""

from __future__ import annotations

from dragline.plans import filings, funds, runs

QUERIES: dict = {}
ORACLE: dict = {}
for _part in (funds, filings, runs):
    QUERIES.update(_part.QUERIES)
    ORACLE.update(_part.ORACLE)
