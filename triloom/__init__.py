"""triloom: triangle meshes as Spark DataFrames."""
