"""Conversation analytics as Spark jobs: profiles, drift, intent, retrieval."""
