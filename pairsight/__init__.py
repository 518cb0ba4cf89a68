"""Pair-risk analytics as Spark jobs: categories, rules, scores, evaluation and attribution."""
