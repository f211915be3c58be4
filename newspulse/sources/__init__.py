"""Readers and writers: landed CSV, JSON, HTML and text files, SQL tables, snapshots, models."""
