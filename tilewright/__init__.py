"""Tilewright: interactive window analytics over large two-axis tables, on Spark."""
