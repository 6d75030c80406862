"""areapanel: area-by-month panels from event points, polygons and value series, on PySpark."""
