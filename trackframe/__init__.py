"""trackframe: Spark-native analytics for tracked moving objects."""
