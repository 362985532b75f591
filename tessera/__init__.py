"""PySpark-native engine for language-model training data and its evaluation."""
