"""plumage: a PySpark-native library of DataFrame operators for tweet corpora.

Every operator maps ``DataFrame -> DataFrame``; Catalyst plans the physical side.
"""
