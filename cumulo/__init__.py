"""cumulo: storm-object analytics and large-table operators written for Spark DataFrames."""
