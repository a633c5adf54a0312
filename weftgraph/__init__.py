"""weftgraph: property graphs, event streams and training-text preparation on Spark DataFrames."""
