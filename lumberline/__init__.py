"""Log and trace analytics expressed as Spark DataFrame plans."""
