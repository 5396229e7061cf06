"""Dictionary tagging, co-occurrence and text operators on Spark DataFrames.

``ship(spark)`` once for a session makes the package importable in its workers, where it isn't installed on all machines.
"""

from termloom.sources.shipping import ship_package as ship

__all__ = ["ship"]
