"""Operators from tables to tables: ranking, fairness, state and reports."""
