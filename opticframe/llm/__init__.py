"""Training-data pipeline operators.

Every operator takes and returns DataFrames, reads only the columns it names (extra columns, also
ones that clash with names of a result, are ignored), and keeps whatever it must cut lineage with in
the shared folder of ``spark.checkpoint.dir``.  Nothing else in the library imports this package.
"""
