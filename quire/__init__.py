"""quire: document-intake analytics expressed as Spark DataFrame plans."""
