"""driftline: snapshot reconciliation and corpus preparation on PySpark DataFrames."""
