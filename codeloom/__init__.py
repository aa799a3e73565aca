"""Code-entity graph analytics on Spark: DataFrame operators over nodes, edges, audit rows and source files."""
