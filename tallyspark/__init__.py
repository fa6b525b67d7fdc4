"""tallyspark: evaluation analytics on Spark.

Scores many competing systems on one large set of items: candidate-output
normalisation, item x variant task grids, pass rates, stability-aware text
comparison, judgement parsing and pairwise ratings. Every operator is a
``DataFrame -> DataFrame`` function built from Spark expressions.
"""

__version__ = "0.1.0"
