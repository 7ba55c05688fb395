"""DataFrame operators: every function takes DataFrames and returns one, lazily.

Tables share these columns: ``repo`` and ``path`` name a file, ``size`` is its
size in bytes, ``content`` its bytes (or its text, once decoded).
"""
