"""Operators of the four data models: documents, key-value log, queues, partitioned logs. All are DataFrame to DataFrame."""
