"""hourpanel: hourly forecast-panel analytics on Spark DataFrames.

Every public function takes and returns ``DataFrame`` objects (or ``Column``
expressions) and keeps its heavy work in Catalyst: joins, windows, grouped
aggregates and column expressions. Nothing here holds a global session.
"""

__version__ = "0.1.0"
