"""Relational operators on meshes: DataFrame in, DataFrame out."""
