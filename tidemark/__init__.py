"""tidemark: retrieval and corpus analytics over timed transcripts, expressed as Spark plans."""
