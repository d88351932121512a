"""DataFrame to DataFrame operators: lookups, aggregates, windows, matching."""
