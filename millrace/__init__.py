"""millrace: a lakehouse analytics engine on the PySpark DataFrame, SQL and Structured Streaming APIs."""
