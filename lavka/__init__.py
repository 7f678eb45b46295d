"""Retail catalogue, order and import jobs on Spark DataFrames.

Every public function takes DataFrames and returns DataFrames (or a named
tuple of them); nothing here owns a session and nothing runs on the driver
except plan building.
"""
