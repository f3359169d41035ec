"""Document-annotation and transcription analytics as Spark DataFrame operators."""
