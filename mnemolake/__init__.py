"""mnemolake: Spark-native trust-aware memory analytics over plain DataFrames."""
