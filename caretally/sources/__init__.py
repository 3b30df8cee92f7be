"""Reading extracts and writing reports."""
