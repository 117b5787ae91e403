"""tessera: a Spark-native SQL analytics engine."""
