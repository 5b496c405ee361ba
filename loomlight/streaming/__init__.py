"""Job logs, status machines, token streams and counters as streams."""
