"""Scenes, motions and file formats as DataFrames, and their sinks."""
