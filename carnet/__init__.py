"""carnet: clinical-notes and cohort analytics expressed as Spark DataFrame transformations."""
