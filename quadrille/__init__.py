"""quadrille: gridded-biodiversity analytics as PySpark DataFrame functions."""
