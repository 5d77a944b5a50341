"""Training-data operators: one module each, all on DataFrames; nothing outside this subpackage imports it."""
