"""gaugewell: data-quality analytics expressed as Spark DataFrame plans."""
