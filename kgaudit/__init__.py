"""Graph-reconciliation and code-corpus analytics on PySpark DataFrames."""
