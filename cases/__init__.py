"""The library's operators and reports run on the driver's tables.

Each module holds ``QUERIES`` (name -> callable) and ``ORACLE`` (name -> the same
question as DuckDB SQL, written independently).
"""
