"""Spark-native analytics for hourly station observations.

Every public function takes DataFrames and returns a lazy DataFrame. Nothing in
the package holds a session, collects rows or starts a job on its own, except
the table writers in ``sources`` and the stream starters in ``streaming``.
"""
