"""Numeric kernels without Spark."""
