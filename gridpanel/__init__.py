"""gridpanel: a PySpark-native engine for gridded environmental observations and plot-by-month panels."""
