"""Registered queries over the reference operators, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from planeworks.plans import boxes, detectors, extra, pixels, records

_PARTS = (pixels, boxes, records, detectors, extra)
QUERIES: dict = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES: dict[str, str] = {name: text for part in _PARTS for name, text in part.ORACLES.items()}
