"""grainmill: PySpark-native analytics over program graphs, event lifecycles and text corpora."""
