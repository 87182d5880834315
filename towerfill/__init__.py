"""towerfill: clean, profile and gap-fill sensor time series with Spark.

Public functions take and return ``DataFrame`` objects.  Most are lazy; the
exceptions run small jobs when called: model fits, the aggregates that fix
thresholds, quotas, vocabularies or the window path (one count per series), and
``session.cut_lineage``, which writes an intermediate table to the shared
checkpoint folder.  Ordered operators take a
:class:`~towerfill.timeline.Timeline` that names the series key and a total
row order, so one table can hold any number of towers / sensors.
"""

from towerfill.timeline import Timeline

__all__ = ["Timeline"]
__version__ = "0.1.0"
