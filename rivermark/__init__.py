"""Fund-flow analytics over large transfer tables, written as Spark jobs."""
