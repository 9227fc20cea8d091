"""quirelake: a PySpark-native analytics engine for catalogues of papers."""
