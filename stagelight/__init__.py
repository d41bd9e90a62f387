"""Event listings as DataFrames: normalise, resolve, serve, audit."""
