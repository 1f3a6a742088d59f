"""Reading and writing edge lists, adjacency and partitioned graphs."""
