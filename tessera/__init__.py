"""tessera: analytics of large sparse count matrices on PySpark."""
