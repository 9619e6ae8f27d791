"""Readers and writers of graph folders, configurations, solutions, projects and source text."""
