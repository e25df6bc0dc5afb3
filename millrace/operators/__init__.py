"""Queries and rules over tables of postings, reviews and assessments: DataFrame in, DataFrame out."""
