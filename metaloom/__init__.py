"""metaloom: sequencing-metadata analytics on PySpark DataFrames."""
