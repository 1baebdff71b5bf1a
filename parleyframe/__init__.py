"""Speech-transcript analytics on Spark, keyed by recording.

The building blocks are plain functions from DataFrames (or columns) to
DataFrames (or columns):

* ``functions``  column expressions: text, numbers, intervals, prompts, vectors
* ``sources``    transcript JSON, speaker-turn lines, audio tables, durable tables
* ``operators``  overlap join, evidence profiles, naming, voices, audio, models
* ``plans``      whole jobs chained from the operators
"""
