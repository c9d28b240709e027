"""cascata: alarm-stream, topology and fault-group analytics on PySpark DataFrames."""
