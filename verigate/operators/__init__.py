"""DataFrame operators: deduplication, splits, joins, verdicts, rates, rankings."""
