"""Résumé and job-posting analytics as PySpark DataFrame transformations."""
