"""opsframe: operational-report operators and reports as Spark DataFrame functions.

Every public function takes DataFrames (or Columns) and returns a DataFrame (or
Column). Nothing here collects rows to the driver except a few one-row scalar
checks whose size is fixed (documented where used).
"""

__version__ = "0.1.0"
