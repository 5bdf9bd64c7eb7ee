"""psmweave: peptide-spectrum match tables as Spark DataFrames.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns).  See README.md for the map from operator ids to functions.
"""

__version__ = "0.1.0"
