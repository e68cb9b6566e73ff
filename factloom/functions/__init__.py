"""Column functions: text, URL, entity, date, number, HTML and label expressions.

All are built-in Spark expressions, so they stay inside the JVM and can be pushed, pruned and folded.
"""
