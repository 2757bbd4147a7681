"""Training-data operators on the ``documents`` family of tables.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is there.
"""
