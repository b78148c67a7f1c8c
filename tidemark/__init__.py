"""tidemark: e-commerce analytics as plain PySpark DataFrame functions.

Each operator takes DataFrames and returns a DataFrame, so it can be read, explained and
optimised by Spark as part of any larger query. Unless its docstring says otherwise an operator
accepts batch and streaming DataFrames alike.
"""
