"""flowlake: Spark-native analytics over cross-chain token transfers."""
