"""City-scale spatial and mobility analytics as plain PySpark DataFrame functions."""
