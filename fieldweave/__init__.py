"""fieldweave: Spark-native alignment and field-by-field comparison of vulnerability records."""
