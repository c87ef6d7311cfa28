"""strandmill: analytics operators for model-service logs, question banks and text corpora, on PySpark.

Every operator is a function from DataFrames to a DataFrame. Nothing here needs a particular cluster: operators
declare plans, and the few that need a driver-side decision read only numbers of a stated bound.
"""

__version__ = "0.1.0"
