"""Territory analytics as PySpark jobs: every operator is a plain function from DataFrames to a DataFrame."""
