"""lodeframe: an analytics engine written on PySpark's DataFrame, SQL and streaming APIs."""
