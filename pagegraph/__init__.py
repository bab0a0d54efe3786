"""pagegraph: Spark-native analytics over collected documentation sites and text corpora."""
