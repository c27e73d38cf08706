"""Base relations and the registered queries, by area."""
