"""Frameloom: tables of timestamped frames, cut into segments and timelines by Spark."""
