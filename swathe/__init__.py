"""swathe: Spark-native analytics for catalogues of image tiles."""
