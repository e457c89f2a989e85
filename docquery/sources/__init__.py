"""Tables, transactions and writes on versioned Parquet."""
