"""Column functions: text clean-up, header matching, quantities. All are JVM expressions."""
