"""Planar polygon networks on Spark: geometry, matching, evaluation and topology of many snapshots at once."""
