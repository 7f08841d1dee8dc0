"""Operators for preparing training text, and their registered queries.

Those that send texts to Python set spark.sql.execution.arrow.maxBytesPerBatch to 4 MB on the session of their input
(text.bounded). It must hold when a lazy result runs, so it stays set; it changes no results.
"""
