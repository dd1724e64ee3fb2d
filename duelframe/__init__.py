"""duelframe: two-sided event features on Spark DataFrames.

A fact table with two participants per row (a game, a match, a contest)
is mirrored into one row per participant, enriched with time-valid
dimensions, turned into leak-free per-participant sequence features with
shared window specifications, re-paired into model rows, and scored in
bulk with Spark ML.

Every operator is a ``DataFrame -> DataFrame`` function; column names are
parameters so the same code runs on the sports schema and on the driver's
tables.
"""

from duelframe.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
