"""tactigrid: analytics for sequences of small sensor grids and pen samples, on PySpark."""
