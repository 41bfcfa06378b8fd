"""cutroom: content analytics, media matching and timeline work as Spark DataFrame operators."""
