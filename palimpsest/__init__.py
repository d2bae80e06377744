"""A Spark-native engine for hybrid retrieval and the data work around it.

Everything takes and returns DataFrames; nothing runs before an action unless a
docstring says that a stage is written.
"""

__version__ = "0.1.0"
