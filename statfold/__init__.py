"""statfold: statistical analytics operators on Spark DataFrames.

Every operator takes DataFrames and returns DataFrames; the heavy work is
declared with the DataFrame API so Catalyst plans it and executors run it.
"""

__version__ = "0.1.0"
