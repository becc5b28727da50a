"""Stand-in tables over the test data and the registered queries."""
