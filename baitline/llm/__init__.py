"""Training-data operators; nothing else in the library imports this package.

``REGISTRY`` maps a query name to ``fn(spark, sf_dir) -> DataFrame`` and
``ORACLE`` holds DuckDB SQL for those that SQL can express.
"""
