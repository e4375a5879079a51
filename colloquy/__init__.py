"""Spark jobs for conversation analytics: transcripts and live segments in, features, scores and findings out."""
