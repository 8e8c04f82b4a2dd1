"""The document compiler: plain Python, without Spark, one document at a time."""
