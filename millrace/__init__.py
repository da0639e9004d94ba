"""ETL operators for PySpark: plain functions from DataFrame to DataFrame."""
