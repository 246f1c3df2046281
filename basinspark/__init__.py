"""Spark DataFrame operators for hydrological and environmental tables."""
