"""Training-data operators: one module an operator, all on DataFrames."""
