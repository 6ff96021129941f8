"""velamen: document analytics on PySpark, written as declarative DataFrame plans."""
