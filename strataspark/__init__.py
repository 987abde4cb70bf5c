"""A seismic analytics engine on PySpark DataFrames."""
