"""Electric-vehicle telemetry analytics on Spark.

Every operator is a function from DataFrames to a DataFrame.  Nothing is
collected to the driver; row-level work stays in Spark's own expressions.
"""

#: Default key of every table.  ``keys=()`` treats all rows as one vehicle.
VEHICLE = ("vehicle_id",)
