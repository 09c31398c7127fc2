"""Tallymark: checked facts about tables, computed as Spark jobs.

A missing value never becomes a number, pairs are filtered pairwise, every
result carries how many observations it rests on, and the same input gives the
same answer whatever the partitioning.
"""

__version__ = "0.1.0"
