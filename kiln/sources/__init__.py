"""Sources and sinks: parquet/CSV/JDBC readers, staging sync, models, table writes."""
