"""driftgate: Spark-native fact reconciliation, snapshot drift and policy gating.

Every public function is DataFrame -> DataFrame (or Column -> Column) over built-in
Spark expressions; nothing is collected to the driver except one-row results.
"""

__version__ = "0.2.0"
