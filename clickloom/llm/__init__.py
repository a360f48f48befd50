"""Training-data operators: ten corpus-scale operators, their queries and SQL.

Nothing outside this package imports it; deleting the folder removes the
operators and leaves the rest of the library untouched.
"""
