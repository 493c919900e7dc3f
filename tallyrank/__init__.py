"""tallyrank: label-free selection of anomaly detectors over Spark DataFrames."""
