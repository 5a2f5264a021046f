"""docmill: document analytics and retrieval as PySpark DataFrame functions."""
