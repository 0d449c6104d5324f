"""A PySpark-native engine for nearest-neighbour fraud scoring of card transactions."""
