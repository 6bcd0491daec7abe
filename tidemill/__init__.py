"""tidemill: data-processing queries and operators written for PySpark."""
