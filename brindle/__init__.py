"""Code-intelligence analytics on Spark: symbol, edge, text and vector tables and the queries over them."""
