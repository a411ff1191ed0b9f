"""contentloom: model-driven content data as Spark DataFrames.

Every operator takes DataFrames and returns a lazy DataFrame built from Spark's
own expressions, so Catalyst plans the work and rows stay in the JVM.
"""
