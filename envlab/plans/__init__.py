"""Composite jobs (what a user calls). Each returns lazy DataFrames; sinks are separate."""
