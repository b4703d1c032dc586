"""Text analytics for written communication, declared as Spark plans."""
