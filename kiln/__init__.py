"""kiln: produce trusted tables from raw sources with Spark DataFrames.

Profile -> detect and mask personal data -> map to a target standard ->
clean -> check quality -> deliver. Every operator takes and returns
DataFrames or Column expressions so Catalyst plans the whole flow.
"""

__version__ = "0.1.0"
