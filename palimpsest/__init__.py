"""A PySpark-native engine for versioned JSON data: logs, branches, indexes and the questions they raise."""
