"""Parts-list analytics on Spark: find the parts-list pages of many documents and turn them into one table."""
