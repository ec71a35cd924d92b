"""foreshock: forecasting rare, dated events from sensor time series on Spark.

Every operator is a function from DataFrames to a DataFrame.  Raw samples are
reduced to window metrics, labelled look-back windows are expanded into
features, features are ranked, seeded classifiers are trained, and their scores
become consensus probabilities that are evaluated and explained.
"""

__version__ = "0.1.0"
