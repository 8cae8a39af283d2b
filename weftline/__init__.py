"""weftline: record linkage and large-table processing as Spark DataFrame plans."""
