"""flipwise: outcome analytics on Spark.

Cleaning, feature derivation, outcome profiling, distribution summaries,
cohort filters, MLlib training and scale-out evaluation, risk tiers and
what-if scenarios, each a ``DataFrame -> DataFrame`` function.
"""

__version__ = "0.1.0"
