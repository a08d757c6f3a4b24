"""Document analytics on Spark: pages to fields, tables and searchable records."""
