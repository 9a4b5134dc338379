"""The steps. Each is a function of a frame and a Config and returns a frame.

Sample steps work on one row per sample, partitioned by ``site`` (if there is one) and
``period_end_us`` and sorted by the in-period index ``i`` once; whole-period figures are window
aggregates over that order, so no step shuffles again and none joins. Period steps are column
arithmetic on one row per period.
"""
