"""qanat: cash-ledger analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns a DataFrame; only the sinks and the batch plans act.
"""
