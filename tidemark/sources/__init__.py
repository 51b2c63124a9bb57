"""Reading and writing: line protocol, JSON events, message topics, CSV with rules, and the Parquet store."""
