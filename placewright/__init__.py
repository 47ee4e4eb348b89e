"""placewright: curation, matching, ranking and search of place and event tables on Spark.

Every public function takes and returns DataFrames (or Columns).
"""
__version__ = "0.1.0"
