"""Sources: logs, signals and dimension tables as DataFrames with declared schemas."""
