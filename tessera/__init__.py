"""tessera: vector search and corpus processing expressed as Spark plans."""
