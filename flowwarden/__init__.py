"""flowwarden: network-flow analytics and threat scoring on Spark.

Every operator is a function ``DataFrame -> DataFrame`` (or ``Column -> Column``
for scalar helpers); fitted steps are small estimator/model objects whose state
is computed with one Spark aggregation and saved as JSON next to the data.
"""

__version__ = "0.1.0"
