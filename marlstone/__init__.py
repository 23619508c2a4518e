"""Scoring, evaluation and curation of decision-episode logs on Spark."""
