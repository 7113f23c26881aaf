"""Fleet-scale analytics over photogrammetry captures, as Spark DataFrame operators.

Every operator takes and returns DataFrames that carry ``capture_id`` (or
``mesh_id`` / ``run_id``), so one call covers any number of captures.
"""
