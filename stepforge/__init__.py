"""Step functions (piecewise constant functions), tensors of them and barcode summaries as Spark DataFrames."""
