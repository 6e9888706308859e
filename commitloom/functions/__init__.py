"""Column -> Column building blocks; every one of them is a native Spark expression."""
