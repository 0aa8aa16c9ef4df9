"""lexloom: text feature analytics and training-data preparation on PySpark."""
