"""ontospark: a Spark-native analytics engine for ontologies and other concept hierarchies."""
