"""linkloom: link discovery in large typed graphs, written as Spark DataFrame plans."""
