"""Mizan: a PySpark-native analytics engine for classified-ad markets."""
