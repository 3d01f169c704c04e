"""Price, flow and event tables as long DataFrames."""
