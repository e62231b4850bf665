"""Composable analytics operators for Spark DataFrames."""
