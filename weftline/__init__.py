"""weftline: declarative tabular and geospatial workflows compiled to Spark plans."""
