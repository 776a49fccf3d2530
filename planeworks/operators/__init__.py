"""DataFrame operators: aggregates, windows, spatial joins, selection, ledger, detectors."""
