"""Molecular-trajectory and docking analytics as Spark DataFrame functions."""
