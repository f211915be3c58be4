"""Table-to-table operators: DataFrame in, DataFrame out, chained with ``df.transform``."""
