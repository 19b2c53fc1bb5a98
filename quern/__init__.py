"""quern: document and vector analytics expressed as Spark DataFrame plans."""
