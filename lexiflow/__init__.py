"""A PySpark-native engine for analysing and processing prose at corpus scale."""
