"""An analytics engine on Spark: SQL and map/reduce jobs, statistics, pruning, streams, regression and PageRank."""
