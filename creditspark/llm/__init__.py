"""Training-data operators and the queries that apply them.

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds
its queries only where it is present.
"""
