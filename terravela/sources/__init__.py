"""Binary and text formats: Python data sources for reading, DataFrames of lines or bytes for writing."""
