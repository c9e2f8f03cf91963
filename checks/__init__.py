"""Stand-in clinical tables over the test tables, and each operator's query beside its SQL oracle."""
