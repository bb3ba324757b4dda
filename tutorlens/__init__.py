"""tutorlens: learning-content recommendation data and evaluation as Spark jobs."""
