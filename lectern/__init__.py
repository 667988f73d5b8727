"""Lecture transcripts, frames and model answers as Spark tables.

Every operator takes and returns DataFrames keyed by ``video_id``; scalar rules
are plain ``Column`` functions, so Catalyst sees the whole plan.
"""
