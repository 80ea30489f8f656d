"""Tables read as collections, key-value logs, queues and logs; snapshots."""
