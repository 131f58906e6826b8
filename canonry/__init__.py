"""canonry: Spark-native analytics for large collections of legal documents.

Every operator is a function from DataFrames to a DataFrame and stays lazy
unless its docstring says otherwise.
"""
