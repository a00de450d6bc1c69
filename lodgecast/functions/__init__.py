"""Column expressions; all of them stay inside generated code."""
