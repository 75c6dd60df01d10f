"""quern: evaluation analytics for binary detectors over catalogued items, on Spark."""
