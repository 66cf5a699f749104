"""tesselar: a Spark-native document-intelligence engine."""
