"""Readers and writers: capture files, analytic tables, and the sample-table adapter."""
