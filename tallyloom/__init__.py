"""Spark-native medallion engine for KPI actuals and order costs."""
