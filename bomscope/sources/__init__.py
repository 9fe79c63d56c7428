"""Where pages and tables come from."""
