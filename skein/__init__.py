"""skein: a Spark-native engine for code-intelligence and corpus analytics."""
