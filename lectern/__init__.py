"""Lectern: documents in, narration-ready tables out, on Spark."""
