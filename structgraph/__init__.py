"""structgraph: structural-graph analytics on PySpark DataFrames."""
